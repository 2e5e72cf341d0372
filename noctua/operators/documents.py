"""Document processing: passages of bounded length, sentences, claims, quality of extracted text, candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from noctua.functions import dims, text
from noctua.functions.batches import in_slices
from noctua.operators import alike, pairs
from noctua.sources.tables import stored

TARGET, OVERLAP, LOOK_BACK = 1500, 220, 240
_BLOCKS = T.ArrayType(T.StructType([T.StructField("heading", T.StringType()), T.StructField("paragraph", T.StringType())]))
_CANDIDATES = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("rank", T.IntegerType()), ("mem_type", T.StringType()), ("title", T.StringType()), ("body", T.StringType()), ("confidence", T.DoubleType()))]))


def passages(c: Column) -> Column:
    """The passages of a text, an array.

    A passage has at most 1500 characters, ends at the last white space of its last 240 if there is any, and begins
    220 before the end of the one before. A fold inside the row finds the cuts: no shuffle and no recursion.
    """
    least_step = TARGET - LOOK_BACK - OVERLAP

    def cut(whole: Column, n: Column) -> Column:
        def step(acc, _):
            s = acc["at"]
            hard = F.least(s + TARGET, n)
            floor = F.greatest(hard - LOOK_BACK, s + 1)
            found = F.length(F.regexp_extract(F.substring(whole, floor + 1, hard - floor), rf"(?s)\A.*{text.BLANK}", 0))
            end = F.when((hard < n) & (found > 0), floor + found).otherwise(hard)
            following = F.when(end >= n, n).otherwise(F.greatest(F.lit(0), end - OVERLAP))
            return F.when(s >= n, acc).otherwise(F.struct(following.alias("at"), F.concat(acc["spans"], F.array(F.struct(s.alias("s"), end.alias("e")))).alias("spans")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("spans"))
        turns = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / least_step).cast("int")))
        spans = F.aggregate(turns, start, step, lambda a: a["spans"])
        return F.filter(F.transform(spans, lambda x: text.trimmed(F.substring(whole, x["s"] + 1, x["e"] - x["s"]))), lambda x: x != "")

    return text.let(F.replace(F.replace(c, F.lit("\x00"), F.lit("")), F.lit("\r\n"), F.lit("\n")), lambda whole: text.let(F.length(whole), lambda n: cut(whole, n)))


def chunked(docs: DataFrame, body: str = "text") -> DataFrame:
    """``docs`` with a row for each passage (``chunk_index``, ``chunk``) instead of the text."""
    return docs.select(*(c for c in docs.columns if c != body), F.posexplode(passages(F.col(body))).alias("chunk_index", "chunk"))


def sentences(c: Column) -> Column:
    """Sentences of a paragraph: all of it up to 320 characters, else cuts at ``.!?`` before white space, 45 on at least."""
    # the shortest run from 46 characters on that ends so, again and again, and what is left; one pass over the text
    cut = lambda x: F.transform(F.regexp_extract_all(x, F.lit(rf"(?s).{{45,}}?[.!?](?={text.BLANK})|.+"), F.lit(0)), text.trimmed)
    return text.let(text.trimmed(c), lambda x: F.when(F.length(x) <= 320, F.array(x)).otherwise(F.filter(cut(x), lambda y: F.length(y) >= 45)))


def claim_score(heading: Column, claim: Column) -> Column:
    """Points of a claim under a heading; null for one that is too short, too long, an object, or below 16."""

    def points(said: Column, low: Column) -> Column:
        score = F.lit(10)
        for needle, more in dims.CLAIM_POINTS.items():
            score += F.when(F.contains(low, F.lit(needle)), more).otherwise(0)
        score += F.when(said.rlike(r"\b20\d{2}-\d{2}-\d{2}\b"), 12).otherwise(0)
        score += F.when(text.any_of(said, ("`", "POST /", "GET /")), 8).otherwise(0)
        return score - F.when(F.contains(low, F.lit("example")), 7).otherwise(0)

    def rated(said: Column) -> Column:
        # a claim of the wrong length is not searched
        score = text.let(text.ascii_lower(F.concat(heading, F.lit(" "), said)), lambda low: points(said, low))
        return F.when(F.length(said).between(45, 1000) & ~F.startswith(said, F.lit("{")), text.let(score, lambda x: F.when(x >= 16, x)))

    return text.let(text.trimmed(claim), rated)


def is_decision(heading: Column, claim: Column) -> Column:
    low = text.ascii_lower(F.concat(heading, F.lit(" "), text.trimmed(claim)))
    return F.contains(text.ascii_lower(heading), F.lit("decision")) | text.let(low, lambda x: text.any_of(x, dims.DECISION_PHRASES))


def block_lists(docs: DataFrame, body: str) -> DataFrame:
    """``docs`` with ``blocks``, an array of (heading, paragraph), instead of the text: paragraphs and list items of
    markdown, each under its heading.

    Code fences, code components, import lines and rules are left out. What a line is depends on the lines before it
    in its document alone, so this is one pass over each text, in slices of batches.
    """
    rows = docs.select(*(c for c in docs.columns if c != body), F.col(body).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [list(_blocks(b or "")) for b in batch.columns[-1].to_pylist()]
            edges = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            parts = [pa.array([x[k] for each in found for x in each], pa.string()) for k in (0, 1)]
            lists = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays(parts, ["heading", "paragraph"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "blocks"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("blocks", _BLOCKS)]))


def blocks(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, ord, heading, paragraph): a row for each of ``block_lists``."""
    rows = block_lists(docs.select(key, body), body).select(key, F.posexplode("blocks").alias("ord", "b"))
    return rows.select(key, "ord", "b.heading", "b.paragraph")


def _is_numbered(line: str) -> bool:
    head = line[: len(line) - len(line.lstrip("0123456789.)"))]
    first = min((i for i in (line.find("."), line.find(")")) if i >= 0), default=-1)
    return any(c.isdigit() for c in head) and first >= 0 and line[first + 1 : first + 2] == " "


def _blocks(body: str) -> Iterator[tuple[str, str]]:
    heading, open_, skipping = "Overview", [], None
    for raw in body.replace("\r\n", "\n").split("\n"):
        line = raw.strip()
        fence = line.startswith(("```", "~~~"))
        if skipping == "fence":
            skipping = None if fence else skipping
            continue
        if skipping == "component":
            skipping = None if not fence and line.endswith("/>") else skipping
            if not fence:
                continue
        ends = fence or not line or line.startswith(("#", "<CodeBlock"))
        item = not ends and (line.startswith(("- ", "* ")) or _is_numbered(line))
        if (ends or item) and open_:
            yield heading, " ".join(open_)
            open_ = []
        if fence:
            skipping = "fence"
        elif line.startswith("<CodeBlock"):
            skipping = "component"
        elif line.startswith("#"):
            heading = line.lstrip("#").strip()
        elif item:
            yield heading, line.lstrip("-* ").lstrip("0123456789.)").strip()
        elif line and not (line.startswith(("import ", "export ", "<APIResponseCodes")) or line == "---"):
            open_.append(line)
    if open_:
        yield heading, " ".join(open_)


def claim_lists(docs: DataFrame, body: str) -> DataFrame:
    """``docs`` with ``claims``, an array of (heading, claim, score, decision), instead of the text: scored claims of markdown."""

    def of(b: Column) -> Column:
        scored = F.transform(sentences(text.clean_markdown(b["paragraph"])), lambda c: F.struct(c.alias("claim"), claim_score(b["heading"], c).alias("score")))
        kept = F.filter(scored, lambda x: x["score"].isNotNull())
        return F.transform(kept, lambda x: F.struct(b["heading"].alias("heading"), x["claim"].alias("claim"), x["score"].alias("score"), is_decision(b["heading"], x["claim"]).alias("decision")))

    rows = block_lists(docs, body)
    return rows.select(*(c for c in rows.columns if c != "blocks"), F.flatten(F.transform("blocks", of)).alias("claims"))


def claims(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, heading, claim, score, decision): a row for each of ``claim_lists``."""
    return claim_lists(docs.select(key, body), body).select(key, F.inline("claims"))


def candidate_lists(docs: DataFrame, title: str, body: str, most: int = 10) -> DataFrame:
    """``docs`` with ``candidates``, an array of (rank, mem_type, title, body, confidence), instead of the text: the claims
    worth keeping.

    In order of score, then text: at most two of a heading, none that is nearly like one before, ten in all. The choice
    depends on the choices before it, within one document; its claims stay in its row, so nothing is joined or shuffled.
    """
    keep = [c for c in docs.columns if c != body]
    rows = claim_lists(docs.withColumn("_title", F.col(title)), body).select(*keep, "_title", "claims")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            lists = batch.columns[-1]
            edges, flat = np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()]), lists.flatten()
            head, said, score, decided = (flat.field(k).to_pylist() for k in range(4))
            chosen = [_chosen(t, list(zip(head[a:b], said[a:b], score[a:b], decided[a:b], strict=True)), most) for t, a, b in zip(batch.columns[-2].to_pylist(), edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(chosen, kind)], names=[*keep, "candidates"])

    kind = to_arrow_type(_CANDIDATES)
    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), T.StructField("candidates", _CANDIDATES)]))


def candidates(docs: DataFrame, key: str, title: str, body: str, most: int = 10) -> DataFrame:
    """(key, rank, mem_type, title, body, confidence): a row for each of ``candidate_lists``."""
    return candidate_lists(docs.select(key, F.col(title).alias("_of"), body), "_of", body, most).select(key, F.inline("candidates"))


def _chosen(doc_title: str, claims: list[tuple], most: int) -> list[dict]:
    out, per, prints, titles = [], {}, [], set()
    for head, said, score, decided in sorted(claims, key=lambda c: (-c[2], c[1].encode())):
        heading = _ascii(head)
        if per.get(heading, 0) >= 2:
            continue
        words = {_ascii(w) for w in _alnum(said) if len(w) >= 3}
        if any(_alike(words, p) >= 0.72 for p in prints):
            continue
        name = candidate_title(doc_title, head, said)
        if _ascii(name) in titles:
            name = f"{name[:190]} ({len(out) + 1})"
        titles.add(_ascii(name))
        if len(said) > dims.SHORT_BODY:
            continue
        out.append({"rank": len(out) + 1, "mem_type": "decision" if decided else "fact", "title": name, "body": said, "confidence": 0.84 if score >= 55 else 0.76})
        per[heading] = per.get(heading, 0) + 1
        prints.append(words)
        if len(out) == most:
            break
    return out


def _ascii(s: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in s)


def _alnum(s: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in s).split()


def _alike(a: set[str], b: set[str]) -> float:
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def candidate_title(doc_title: str, heading: str, claim: str) -> str:
    """Heading, or the document's title for a heading that says nothing, and the first twelve words."""
    front = doc_title if _ascii(heading) in ("overview", "introduction", "details", "notes") else heading
    return f"{front}: {' '.join(claim.split()[:12]).rstrip('.,:;')}"[:200]


def candidate_tags(title: Column) -> Column:
    parts = F.filter(F.split(text.import_slug(title), "-"), lambda x: F.octet_length(x) >= 3)
    return F.array_distinct(F.concat(F.array(F.lit("document-import")), F.slice(parts, 1, 4)))


def pdf_text(c: Column) -> Column:
    """Extracted text without NUL, form feeds as blank lines, lines without white space at their ends."""
    c = F.replace(F.replace(c, F.lit("\x00"), F.lit("")), F.lit("\x0c"), F.lit("\n\n"))
    return text.trimmed(F.regexp_replace(c, r"[^\S\n]+(?=\n|\z)", ""))


def best_attempt(attempts: DataFrame, key: str) -> DataFrame:
    """Of extraction attempts (key, engine_order, text) the first that passes, else the best, the last of equals."""
    q = text.quality(F.col("text"))
    rated = attempts.withColumn("q", q).withColumn("score", text.quality_score(F.col("q"))).withColumn("passed", text.quality_passed(F.col("q")))
    rank = F.struct(F.col("passed"), F.when(F.col("passed"), -F.col("engine_order")).otherwise(F.col("score")), F.col("engine_order"))
    return rated.groupBy(key).agg(F.max_by(F.struct("engine_order", "score", "passed"), rank).alias("x")).select(key, "x.*")


def near_duplicates(docs: DataFrame, theta: float = 0.72, part: int = pairs.PART) -> tuple[DataFrame, DataFrame]:
    """Classes (doc_id, class_id) of documents (doc_id, text) with equal sets of words, named by their least id, and all pairs
    (a, b), a < b, of classes whose sets have Jaccard similarity ``theta`` or more. Copies are not paired one by one.

    Texts are read once and their words kept as hashes. Two sets that are alike share a rare word, or two words that are neighbours in
    the order of frequency; what so meets is held against marks of fixed size, and what is left is compared whole (``operators/alike.py``).
    Sets travel once for each cell of others, not once for each pair. Documents without words are classes of their own, without pairs.
    """
    d = docs.select("doc_id", F.array_sort(text.term_set(F.col("text"))).alias("w"))
    key = F.when(F.size("w") > 0, F.substring(F.unhex(F.sha2(F.array_join("w", " "), 256)), 1, 16)).otherwise(F.col("doc_id").cast("string").cast("binary"))
    d = d.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("key"), F.transform(F.coalesce("w", F.array().cast("array<string>")), lambda x: F.xxhash64(x)).alias("h"))
    # of copies in a batch only the first keeps its words
    order = Window.partitionBy("key").orderBy("doc_id", F.col("w").isNull())
    d = d.mapInArrow(_packed, "doc_id bigint, key binary, w binary").withColumn("id", F.first("doc_id").over(order)).withColumn("nth", F.row_number().over(order))
    d = d.select("doc_id", "id", F.when((F.col("nth") == 1) & (F.octet_length("w") > 0), F.col("w")).alias("w"))
    d = stored(_marked(d, theta, rare=False), "near_sets")
    sets = d.where("w IS NOT NULL").drop("doc_id")
    may = stored(alike.likely(alike.met(sets, theta, part), sets, theta, MARKS, WIDE), "near_likely")
    kind = docs.schema["doc_id"].dataType
    found = alike.exact(may, sets, theta, part).select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))
    return d.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("id").cast(kind).alias("class_id")), found


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, key = batch.column(0).fill_null(0).to_numpy(), batch.column(1).dictionary_encode().indices.to_numpy()
        order = np.lexsort((ids, key))
        first = np.zeros(len(ids), bool)
        first[order[np.diff(key[order], prepend=-1) != 0]] = True
        w = pc.if_else(pa.array(first), alike.packed_words(batch.column(2)), pa.scalar(None, pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), w], names=["doc_id", "key", "w"])


#: Counters of words by hash, a table of fixed size that goes to all tasks; longs of a set's marks.
COUNTERS, MARKS = 1 << 20, 16
#: Sets of more words have wide marks too, of so many longs: in the others' few bits long sets look alike.
LONG, WIDE = 300, 64


def _marked(sets: DataFrame, theta: float, rare: bool = True) -> DataFrame:
    """(n, rare, marks, wide) of sets beside their columns: size, the rarest words as (x, k), hash and place, and marks.

    ``w`` has the words, which are left out then, or their hashes as ``alike`` packs them. The order of words is that of their counters,
    then hashes: any one order of all words finds all pairs, and this one needs no join of words with their frequencies. A word whose
    counter is 1 is in no other set. ``marks`` tell for each of 64 MARKS classes of words whether the set holds an odd number of them, so
    two sets' marks differ in no more places than the sets do; the wide ones folded are the others.
    """
    packed = sets.schema["w"].dataType == T.BinaryType()
    kept = [c for c in sets.columns if packed or c != "w"]
    hashed = sets if packed else sets.withColumn("w", F.transform("w", lambda x: F.xxhash64(x)))
    hashed = hashed.select(*(c for c in kept if c != "w"), "w")
    counters = np.zeros(COUNTERS, np.int32)
    if rare:
        buckets = hashed.select(F.explode("w").alias("h")).groupBy(F.pmod("h", F.lit(COUNTERS)).cast("int").alias("at")).agg(F.count("*").alias("n")).toArrow()
        counters[buckets["at"].to_numpy()] = np.minimum(buckets["n"].to_numpy(), np.iinfo(np.int32).max)
    names = [c for c in hashed.columns if c in kept]
    out = [*names, "n", *["rare"] * rare, "marks", "wide"]

    def rarest(n: np.ndarray, x: np.ndarray, row: np.ndarray) -> pa.Array:
        start, count = np.cumsum(n) - n, counters[x % COUNTERS]
        order = np.lexsort((x, count, row))
        place = np.arange(len(x)) - start[row]  # rows stay together in this order
        keep = (place < (n - np.ceil(n * theta - 1e-9) + 1)[row]) & (count[order] > 1)
        edges = np.append(0, np.cumsum(np.bincount(row[keep], minlength=len(n)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(x[order][keep]), pa.array((place[keep] + 1).astype(np.int32))], ["x", "k"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            w = batch.column(batch.num_columns - 1)
            n, x = alike.words_of(w) if packed else (w.value_lengths().to_numpy().astype(np.int64), w.flatten().to_numpy())
            row = np.repeat(np.arange(len(n)), n)
            marks = _odd(x, row, len(n), MARKS)
            long = np.flatnonzero(n > LONG)
            at = np.full(len(n), -1)
            at[long] = np.arange(len(long))
            own = at[row] >= 0
            wide = _odd(x[own], at[row[own]], len(long), WIDE).take(pa.array(at, mask=at < 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(n.astype(np.int32)), *([rarest(n, x, row)] if rare else []), marks, wide], names=out)

    kinds = {c: hashed.schema[c].dataType.simpleString() for c in names} | {"n": "int", "rare": "array<struct<x:bigint,k:int>>", "marks": "array<bigint>", "wide": "array<bigint>"}
    return hashed.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in out))


def _odd(x: np.ndarray, row: np.ndarray, rows: int, longs: int) -> pa.ListArray:
    """For each row a bit for each class of its hashes: whether they are odd in number."""
    bits = 64 * longs
    bit = (x.view(np.uint64) >> np.uint64(40)).astype(np.int64) % bits
    odd = (np.bincount(row * bits + bit, minlength=rows * bits) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * longs), pa.array(np.packbits(odd).view(np.int64)))
