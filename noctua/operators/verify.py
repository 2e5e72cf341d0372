"""Grounded answers: claims are kept only if the passages they cite hold all their terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noctua.functions import text

MOST_CLAIMS, MOST_CHARS = 8, 600


def json_object(c: Column) -> Column:
    """From the first ``{`` to the last ``}`` of a text that may hold more; null without."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def supported(claim: Column, evidence: Column) -> Column:
    """Whether all terms of a claim, and one at least, are among those of its evidence."""
    own = text.support_terms(claim)
    return (F.size(own) > 0) & (F.size(F.array_except(own, text.support_terms(evidence))) == 0)


def accepted(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims (question_id, claim_no, text, citations) that hold, with the citations in range.

    ``evidence`` has (question_id, number from 1 on, path, text, score). The first eight claims of a question count.
    """
    rows = claims.where(F.col("claim_no") <= MOST_CLAIMS).withColumn("text", text.trimmed(F.col("text")))
    rows = rows.where((F.col("text") != "") & (F.length("text") <= MOST_CHARS))
    # a few short claims go to each piece of evidence, whose terms are counted once and stay where they are
    cited = rows.select("question_id", "claim_no", "text", text.support_terms(F.col("text")).alias("own"), F.explode(F.array_distinct("citations")).alias("number"))
    cited = cited.where(F.size("own") > 0).groupBy("question_id", "number").agg(F.collect_list(F.struct("claim_no", "text", "own")).alias("claims"))
    met = evidence.select("question_id", "number", F.col("text").alias("said")).join(cited, ["question_id", "number"])

    def missed(x: Column, terms: Column) -> Column:
        return F.struct(x["claim_no"].alias("claim_no"), x["text"].alias("text"), F.coalesce(F.array_except(x["own"], terms), x["own"]).alias("missing"))

    each = met.select("question_id", "number", F.inline(text.let(text.support_terms(F.col("said")), lambda terms: F.transform("claims", lambda x: missed(x, terms)))))
    out = each.groupBy("question_id", "claim_no", "text").agg(F.array_sort(F.collect_list("number")).alias("citations"), F.collect_list("missing").alias("missing"))
    # a term is missing if no piece of evidence has it
    everywhere = F.aggregate("missing", F.get("missing", F.lit(0)), F.array_intersect)
    return out.where(F.size(everywhere) == 0).drop("missing")


def renumbered(kept: DataFrame) -> DataFrame:
    """(question_id, claim_no, text, marks): citations numbered anew from 1 in rising order of the old numbers."""
    each = kept.select("question_id", "claim_no", "text", F.explode("citations").alias("number"))
    each = each.withColumn("new", F.dense_rank().over(Window.partitionBy("question_id").orderBy("number")))
    marks = F.array_join(F.transform(F.array_sort(F.collect_list("new")), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")
    return each.groupBy("question_id", "claim_no", "text").agg(marks.alias("marks"))


def answers(kept: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per question with claims that hold: answer, number of sources, confidence score and level."""
    lines = renumbered(kept).withColumn("line", F.concat(F.regexp_replace("text", r"[. ]+\z", ""), F.lit(" "), F.col("marks")))
    said = lines.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("claim_no", "line"))).alias("x"))
    said = said.select("question_id", F.concat(F.array_join(F.transform("x", lambda y: y["line"]), ". "), F.lit(".")).alias("answer"))
    used = kept.select("question_id", F.explode("citations").alias("number")).distinct().join(evidence, ["question_id", "number"])
    figures = used.groupBy("question_id").agg(F.avg("score").alias("average"), F.count_distinct("path").alias("sources"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.82 * F.col("average") + 0.18 * F.least(F.col("sources"), F.lit(3)) / 3))
    level = F.when((F.col("score") >= 0.78) & (F.col("sources") >= 2), "high").when(F.col("score") >= 0.55, "medium").otherwise("low")
    return said.join(figures.withColumn("score", score), "question_id").select("question_id", "answer", "sources", F.round("score", 6).alias("score"), level.alias("confidence"))
