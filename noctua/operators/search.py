"""Ranked retrieval: exact titles, BM25, recency, trust and staleness; passages, excerpts, evidence, context.

A search reads an ``index.Index``, which follows its table: bounds of blocks, then the entries of the blocks that can hold
one of the best rows. Texts are read only for rows that are returned. Without an index the terms are counted inside the scan
of the texts, and the figures come from one aggregate row that is broadcast. Questions come one by one or as a table.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noctua.functions import dims, text
from noctua.operators.index import K1, B, Index, folded

FIELDS = ("title", "summary", "body", "tags")


def visible(domain: str | None, include_stale: bool = True) -> Column:
    """Filter of rows that a search may return; it reaches the scan."""
    out = F.col("status") != "expired"
    if domain is not None:
        out &= F.col("domain") == domain
    if not include_stale:
        out &= F.col("status") != "stale"
    return out


def refusal(query: Column, most: int = 1000) -> Column:
    """Why a query is not searched for: it is blank or too long."""
    return F.when(F.length(F.trim(query)) == 0, "blank").when(F.length(query) > most, "long")


def query_terms(query: str) -> list[str]:
    """The terms of a search, repeats kept; accents go, as in the index."""
    import re

    table = str.maketrans(text.ACCENTED, text.BASE)
    words = re.split(r"[\W_]+", query.lower())
    return [w.translate(table) for w in words if len(w) > 1 and w not in dims.SEARCH_STOPWORDS]


def tokens(rows: DataFrame, fields: tuple[str, ...]) -> Column:
    """All terms of the fields that the table has, repeats kept."""
    return F.concat(*(text.index_terms(folded(rows, f)) for f in fields if f in rows.columns))


def question_terms(questions: DataFrame, key: str, body: str, *others: str) -> DataFrame:
    """(q, term, others): a row for each term of each question, repeats kept; accents go, as in the index."""
    words = F.transform(text.match_terms(F.col(body)), lambda x: F.translate(x, text.ACCENTED, text.BASE))
    return questions.select(F.col(key).alias("q"), *others, F.explode(words).alias("term"))


def corpus_stats(rows: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(term, df, cf): in how many rows each term occurs, and how often. Rows are counted where they are read; one partial
    sum for each term and task is all that is shuffled."""
    own = rows.select(F.array_sort(tokens(rows, fields)).alias("t"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))))
    each = own.select(F.explode(F.arrays_zip("t", before.alias("b"))).alias("x")).select(F.col("x.t").alias("term"), F.col("x.b").alias("b"))
    return each.select("term", (~F.col("b").eqNullSafe(F.col("term"))).cast("bigint").alias("first")).groupBy("term").agg(F.sum("first").alias("df"), F.count("*").alias("cf"))


def bm25(rows: DataFrame, terms: list[str], fields: tuple[str, ...] = FIELDS, index: Index | None = None) -> DataFrame:
    """``rows`` that hold a term, with ``bm25``; a term that comes twice in the query counts twice. N, lengths and
    frequencies are those of all rows, or of those in the index."""
    if index is not None:
        hits = index.hits(terms).withColumnRenamed("id", "hit_id")
        return rows.join(hits, F.col("id").cast("string") == F.col("hit_id")).select(*rows.columns, "bm25")
    own = sorted(set(terms))
    known = F.array(*map(F.lit, own))
    found = F.struct(F.size("tokens").alias("length"), F.filter("tokens", lambda x: F.array_contains(known, x)).alias("tokens"))
    # through a generator, so that a filter on what follows does not split the texts a second time below it
    rows_ = rows.withColumn("tokens", tokens(rows, fields)).select(*rows.columns, F.inline(F.array(found)))
    counted = rows_.select(*rows.columns, "length", *(_occurrences(w).alias(f"tf_{k}") for k, w in enumerate(own)))
    names = [f"tf_{k}" for k in range(len(own))]
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("average"), *(F.count_if(F.col(x) > 0).alias(f"df_{k}") for k, x in enumerate(names)))
    hit = counted.where(reduce(lambda a, b: a | b, (F.col(x) > 0 for x in names))).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for w in terms:
        k = own.index(w)
        idf = F.greatest(F.ln((F.col("n") - F.col(f"df_{k}") + 0.5) / (F.col(f"df_{k}") + 0.5)), F.lit(1e-6))
        f = F.col(f"tf_{k}")
        score = score + idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("length") / F.col("average")))
    return hit.withColumn("bm25", score).select(*rows.columns, "bm25")


def _occurrences(term: str) -> Column:
    return F.size(F.filter("tokens", lambda x: x == term))


def exact(rows: DataFrame, query: str, limit: int) -> DataFrame:
    """(id, relevance, lane, position): rows whose title is the query, the latest first."""
    hit = rows.where(F.lower(F.trim("title")) == query.strip().lower()).orderBy(F.desc("updated_at"), "id").limit(limit)
    return hit.select("id", F.lit(1.0).alias("relevance"), F.lit(0).alias("lane"), (F.row_number().over(Window.orderBy(F.desc("updated_at"), "id")) - 1).alias("position"))


def ranked(rows: DataFrame, query: str, domain: str | None, include_stale: bool, limit: int, index: Index | None = None) -> DataFrame:
    """(id, relevance, lane, position): the ``limit`` best by BM25, relevance from score and rank."""
    terms = query_terms(query)
    if not terms:
        return rows.where("false").select("id", F.lit(1.0).alias("relevance"), F.lit(1).alias("lane"), F.lit(0).alias("position"))
    live = rows.where(visible(domain, include_stale))
    if index is not None:
        asked = rows.sparkSession.createDataFrame([(0, w) for w in terms], "q int, term string")
        top = index.best(asked, live, limit, tie="doc_id", own=sorted(set(terms)))
    else:
        found = bm25(rows.where("status <> 'expired'"), terms).where(visible(domain, include_stale))
        top = found.withColumn("rounded", F.round("bm25", 9)).orderBy(F.desc("rounded"), "doc_id").limit(limit)
        top = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("rounded"), "doc_id")) - 1).withColumn("q", F.lit(0))  # of ``limit`` rows
    return relevant(top).select("id", "relevance", F.lit(1).alias("lane"), "position")


def relevant(top: DataFrame) -> DataFrame:
    """``top`` (q, bm25, position, …) with ``relevance``: the score as a share of the question's best, and the place."""
    most = F.max("bm25").over(Window.partitionBy("q"))
    share = 0.65 * F.when(most > 0, F.col("bm25") / most).otherwise(F.lit(0.0)) + 0.35 / (1 + F.col("position") * 0.12)
    return top.withColumn("relevance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def search_questions(rows: DataFrame, questions: DataFrame, as_of: str, index: Index, limit: int = 8) -> DataFrame:
    """(q, rank, id, score, relevance): ``search`` for every row of ``questions`` (q, query, and domain, null for all) in one job.

    Exact titles and ranked rows of each question meet by question; a question that is blank or too long finds none."""
    limit = min(50, max(1, limit))
    asked = questions.where(refusal(F.col("query")).isNull()).select("q", "query", "domain")
    live = rows.where(visible(None))
    title = F.lower(F.trim("title"))
    same = live.select("id", "updated_at", title.alias("title"), F.col("domain").alias("own")).join(asked.select("q", "domain", F.lower(F.trim("query")).alias("title")), "title").where(F.col("domain").isNull() | (F.col("domain") == F.col("own")))
    place = Window.partitionBy("q").orderBy(F.desc("updated_at"), "id")
    titled = same.withColumn("nr", F.row_number().over(place)).where(F.col("nr") <= limit).select("q", "id", F.lit(1.0).alias("relevance"), F.lit(0).alias("lane"), (F.col("nr") - 1).alias("position"))
    best = relevant(index.best(question_terms(asked, "q", "query", "domain"), live, limit * 5, tie="doc_id")).select("q", "id", "relevance", F.lit(1).alias("lane"), "position")
    first = titled.union(best).groupBy("q", "id").agg(F.min(F.struct("lane", "position", "relevance")).alias("c")).select("q", "id", "c.*")
    scored = first.join(live.select("id", "updated_at", "mem_type", "confidence", "confirmation_count", "status"), "id").withColumn("score", composite(as_of))
    order = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "lane", "position")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("q", "rank", "id", "score", "relevance")


def age_days(c: Column, as_of: str) -> Column:
    """Whole days since a time or a day, cut towards zero; 0 for anything else."""
    time = c.rlike(r"\A\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}")
    seconds = F.unix_seconds(F.lit(f"{as_of}T00:00:00Z").cast("timestamp")) - F.unix_seconds(F.when(time, c).try_cast("timestamp"))
    days = F.datediff(F.lit(as_of).cast("date"), F.when(~time & c.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), c).try_cast("date"))
    return F.coalesce((seconds / 86400).cast("bigint"), days, F.lit(0)).cast("bigint")


def half_life(mem_type: Column) -> Column:
    out = None
    for k, v in dims.HALF_LIFE.items():
        out = F.when(mem_type == k, v) if out is None else out.when(mem_type == k, v)
    return out.otherwise(180)


def recency(as_of: str) -> Column:
    return F.exp(-log(2) * age_days(F.col("updated_at"), as_of) / half_life(F.col("mem_type")))


def trust() -> Column:
    return F.col("confidence") * F.least(F.lit(1.0), 0.6 + 0.1 * F.col("confirmation_count"))


def composite(as_of: str) -> Column:
    score = 0.60 * F.col("relevance") + 0.25 * recency(as_of) + 0.15 * trust() - F.when(F.col("status") == "stale", 0.30).otherwise(0.0)
    return F.greatest(F.lit(0.0), score)


def search(rows: DataFrame, query: str, as_of: str, domain: str | None = None, include_stale: bool = True, limit: int = 8, index: Index | None = None) -> DataFrame:
    """The best memories for a query, with score and its parts, in order of ``rank``; a blank query finds none."""
    if len(query) > 1000:
        raise ValueError("a query has at most 1000 characters")
    if domain is not None and domain not in dims.DOMAINS:
        raise ValueError(f"unknown domain {domain}")
    limit = min(50, max(1, limit))
    lanes = exact(rows.where(visible(domain, include_stale)), query, limit).union(ranked(rows, query, domain, include_stale, limit * 5, index))
    first = lanes.groupBy("id").agg(F.min(F.struct("lane", "position", "relevance")).alias("c")).select("id", "c.*")
    scored = rows.join(F.broadcast(first), "id").withColumn("score", composite(as_of))
    if not query.strip():
        scored = scored.where("false")
    order = [F.desc(F.round("score", 9)), "lane", "position"]
    top = scored.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _pool(chunks: DataFrame, imports: DataFrame) -> DataFrame:
    usable = imports.where("extraction_quality_status <> 'failed'").select(F.col("id").alias("import_id"))
    return chunks.join(usable, "import_id", "left_semi")


def _rescored(pool: DataFrame, asked: Column, limit: int) -> DataFrame:
    """The ``limit`` best of each question's pool (q, id, import_id, position, body) by the share of its terms ``asked`` that they cover."""
    coverage = F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(asked, text.term_set(F.col("body")))) / F.size(asked))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.72 * coverage + 0.28 / (1 + F.col("position") * 0.18)))
    order = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "position")
    return pool.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("q", "rank", "id", "import_id", "score")


def passages(chunks: DataFrame, imports: DataFrame, query: str, domain: str, limit: int = 8, index: Index | None = None) -> DataFrame:
    """(id, import_id, score): passages by BM25, rescored by the share of query terms they cover."""
    terms = query_terms(query)
    if not terms:
        return chunks.where("false").select("id", "import_id", F.lit(0.0).alias("score"))
    if index is not None:
        asked = chunks.sparkSession.createDataFrame([(0, w) for w in terms], "q int, term string")
        top = index.best(asked, _pool(chunks, imports).where(F.col("domain") == domain), limit * 4, own=sorted(set(terms)))
        hits = chunks.select("id", "import_id", "body").join(F.broadcast(top), "id")  # at most 4 * limit rows
    else:
        hits = _pool(bm25(chunks, terms, ("body",)).where(F.col("domain") == domain), imports).withColumn("rounded", F.round("bm25", 9)).orderBy(F.desc("rounded"), "id").limit(limit * 4)
        hits = hits.withColumn("position", F.row_number().over(Window.orderBy(F.desc("rounded"), "id")) - 1).withColumn("q", F.lit(0))
    return _rescored(hits, text.term_set(F.lit(query)), limit).orderBy("rank").select("id", "import_id", "score")


def passage_questions(chunks: DataFrame, imports: DataFrame, questions: DataFrame, index: Index, limit: int = 8) -> DataFrame:
    """(q, rank, id, import_id, score): ``passages`` for every row of ``questions`` (q, query, and domain, null for all) in one job."""
    asked = questions.where(refusal(F.col("query")).isNull()).select("q", "query", "domain")
    top = index.best(question_terms(asked, "q", "query", "domain"), _pool(chunks, imports), limit * 4)
    hits = top.join(chunks.select("id", "import_id", "body"), "id").join(asked.select("q", text.term_set(F.col("query")).alias("asked")), "q")
    return _rescored(hits, F.col("asked"), limit)


def excerpt(body: Column, question: Column, most: int = 420) -> Column:
    """The sentence that shares most terms with the question, the last of equals."""
    parts = F.filter(F.transform(F.split(body, r"[\n.!?]"), text.trimmed), lambda x: x != "")
    asked = text.term_set(question)
    scored = F.transform(parts, lambda x, i: F.struct(F.size(F.array_intersect(text.term_set(x), asked)).alias("n"), i.alias("i"), x.alias("x")))
    return F.left(F.coalesce(F.array_max(scored)["x"], text.trimmed(body)), F.lit(most))


def fused(evidence: Column, most: int = 8) -> Column:
    """Passages (score, path, text, …) in order of score, without those that nearly repeat an earlier one of the same
    path; at most ``most``. Per row the array has at most 14 entries, so the fold is short."""
    like = lambda a, b: text.similarity(text.support_terms(a), text.support_terms(b))
    order = F.array_sort(evidence, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise((a["ord"] - b["ord"]).cast("int")))
    empty = F.filter(order, lambda x: F.lit(False))
    return F.aggregate(
        order,
        empty,
        lambda acc, x: F.when((F.size(acc) >= most) | F.exists(acc, lambda y: (y["path"] == x["path"]) & (like(y["text"], x["text"]) > 0.82)), acc).otherwise(F.concat(acc, F.array(x))),
    )


def fused_evidence(memories: DataFrame, passages: DataFrame, by: str, memories_most: int = 6, passages_most: int = 8) -> DataFrame:
    """(by, kept): for each question ``by`` the ids of its evidence in order of score. Of its memories and of its passages
    (id, score, path, text, and ``nr`` for equal scores) the best by score enter the fold, texts cut to 1800 characters."""

    def best(rows: DataFrame, most: int, after: int) -> DataFrame:
        ranked = rows.withColumn("text", F.left("text", F.lit(1800))).withColumn("ord", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "nr", "id"))).where(F.col("ord") <= most)
        return ranked.select(by, F.struct("score", "path", "text", (F.col("ord") + after).alias("ord"), "id").alias("e"))

    rows = best(memories, memories_most, 0).unionByName(best(passages, passages_most, memories_most)).groupBy(by).agg(F.collect_list("e").alias("e"))
    return rows.select(by, F.transform(fused(F.col("e")), lambda x: x["id"]).alias("kept"))


def context(results: DataFrame, budget: int = 16_000) -> DataFrame:
    """One row (block, injected, unverified) from search results in order of rank: entries while they fit the byte budget,
    a short form where the whole does not; sensitive rows never."""
    head = F.concat(F.lit('<memory source="'), F.col("vault_path"), F.lit('" status="'), F.col("status"), F.lit('"'), F.when(F.col("status") == "stale", ' verify="UNVERIFIED"').otherwise(""))
    whole = F.concat(head, F.lit(' confirmed="'), F.coalesce("last_confirmed_at", F.lit("never")), F.lit('">\n'), text.xml_escaped(F.coalesce("body", "summary", F.lit(""))), F.lit("\n</memory>\n"))
    short = F.concat(head, F.lit(' compressed="true">'), text.xml_escaped(F.coalesce("summary", F.lit(""))), F.lit(" </memory>\n"))
    rows = results.where("sensitivity <> 'sensitive'").select(F.struct("rank", whole.alias("whole"), short.alias("short"), F.col("vault_path").alias("path"), (F.col("status") == "stale").alias("stale")).alias("x"))
    start = F.struct(F.lit("").alias("block"), F.lit(0).alias("used"), F.array().cast("array<string>").alias("injected"), F.array().cast("array<string>").alias("unverified"))

    def step(acc, x):
        entry = F.when(acc["used"] + F.octet_length(x["whole"]) <= budget, x["whole"]).when(acc["used"] + F.octet_length(x["short"]) <= budget, x["short"])
        return F.when(entry.isNull(), acc).otherwise(
            F.struct(
                F.concat(acc["block"], entry).alias("block"),
                (acc["used"] + F.octet_length(entry)).alias("used"),
                F.concat(acc["injected"], F.array(x["path"])).alias("injected"),
                F.when(x["stale"], F.concat(acc["unverified"], F.array(x["path"]))).otherwise(acc["unverified"]).alias("unverified"),
            )
        )

    return rows.agg(F.aggregate(F.array_sort(F.collect_list("x")), start, step).alias("c")).select("c.*")
