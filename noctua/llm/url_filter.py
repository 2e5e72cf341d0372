"""URL rules by sort-merge range joins, in DataFrame operations only.

A host written backwards by label, ``com.example.www.``, is a canonical key: a rule for ``example.com`` fits the keys
from ``com.example.`` up to, but not including, ``com.example/`` (``/`` follows ``.`` in byte order). So each rule
host is an interval, and intervals of different hosts are nested or apart; and so are the intervals of the paths
of one host, from the path up to all that begins with it.

URLs, interval starts and interval ends are sorted together by key and swept twice: by host, then, for each rule host that a
URL lies in, by host and path. The stack of active rules is kept as its top: a start puts itself on top, an end
what encloses it, which is known from the rules alone. So a sweep is one running ``last``, however deep rules
are nested and however many a host has. Of the tops of all its hosts the longest rule decides a URL.

URLs are dealt by a hash of their row number, not by host, so a host with a third of all rows spreads evenly; rules are
repeated in each deal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import n_buckets

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or none."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _suffixes(host: Column) -> Column:
    """A host and the hosts above it, by label."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _swept(starts: DataFrame, ends: DataFrame, rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with the ``top`` that holds where they stand among starts and ends (deal, *order, top); an end precedes a
    start, and both precede rows, at the same key."""
    kinds = (x.withColumn("kind", F.lit(k)) for x, k in ((ends, 0), (starts, 1), (rows, 2)))
    events = next(kinds).unionByName(next(kinds), allowMissingColumns=True).unionByName(next(kinds), allowMissingColumns=True)
    sweep = Window.partitionBy("deal").orderBy(*order, "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("top", F.last("top", ignorenulls=True).over(sweep)).where("kind = 2").drop("kind")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of each row; ``rules`` has (host, path, verdict).

    A rule fits its host and all subdomains where the URL's path starts with the rule's. Of those that fit, the
    longest (host and path together) wins, on a tie the longer host, and of equal rules ``block``. Without a rule the
    verdict is ``otherwise``. A null url has empty host and path. Repeated rows and rows without an id are judged one by
    one; an empty rule table fits nothing; rules with a null or empty host are left out, a null path is the empty one.
    """
    deals = n_buckets(pages.sparkSession, 1)
    deal = F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal")
    rules = rules.where("host IS NOT NULL AND host <> ''").select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rank = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), (F.col("verdict") == "block").alias("blocks"), F.concat("host", "path").alias("rule"), "verdict")
    rules = rules.groupBy("host", "path").agg(F.max(rank).alias("best"))
    # hosts with the rule hosts they lie in, themselves among them
    hosts = rules.select("host").distinct()
    chains = hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("above")).join(hosts.withColumnRenamed("host", "above"), "above").groupBy("host").agg(F.sort_array(F.collect_list("above")).alias("chain"))
    key = reversed_host(F.col("host"))
    starts = chains.select(deal, key.alias("key"), F.col("chain").alias("top"))
    ends = chains.withColumn("key", key).select(deal, F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")).alias("key"), F.array_remove("chain", F.col("host")).alias("top"))
    url = F.col(url_col).cast("string")
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = urls.withColumn("deal", F.pmod(F.xxhash64("row"), F.lit(deals)).cast("int"))
    met = _swept(starts, ends, urls.withColumn("key", key), "key")
    # rules with the longest one of their host whose path theirs begins with
    shorter = rules.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.length("path")), lambda n: F.left("path", n - 1))).alias("prefix")).where("length(prefix) < length(path)")
    around = shorter.join(rules.select("host", F.col("path").alias("prefix"), F.col("best").alias("outer")), ["host", "prefix"]).groupBy("host", "path").agg(F.max("outer").alias("outer"))
    nested = rules.join(around, ["host", "path"], "left").withColumnRenamed("host", "at")
    raw = F.encode("path", "UTF-8")
    starts = nested.select(deal, "at", raw.alias("key"), F.struct(F.col("best").alias("best")).alias("top"))
    ends = nested.select(deal, "at", F.concat(raw, F.unhex(F.lit("FF"))).alias("key"), F.struct(F.col("outer").alias("best")).alias("top"))
    each = met.select("deal", "row", "id", "host", "path", F.explode_outer("top").alias("at"), raw.alias("key"))
    tops = _swept(starts, ends, each, "at", "key")
    out = tops.groupBy("row").agg(F.first("id").alias(id_col), F.first("host").alias("host"), F.first("path").alias("path"), F.max("top.best").alias("best"))
    return out.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
