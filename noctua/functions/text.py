"""Text scalars as Column expressions: tokenizers, stemming, slugs, HTML and markdown, quality figures, dates.

The tokenizers differ on purpose (least length, stop words, stemming, order); they are not interchangeable.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims

ALNUM_SPLIT = r"[^\p{L}\p{N}]+"
_LETTERS_UP, _LETTERS_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Accented letters and their base letters; ß has none.
ACCENTED, BASE = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _LETTERS_UP, _LETTERS_LOW)


def pieces(c: Column, least: int = 1) -> Column:
    """Runs of letters and digits of at least ``least`` code points, in order, repeats kept."""
    return F.filter(F.split(c, ALNUM_SPLIT), lambda x: F.length(x) >= least)


def match_terms(c: Column) -> Column:
    """Search terms: lower case, longer than 1, without stop words, repeats kept."""
    stop = F.array(*(F.lit(w) for w in dims.SEARCH_STOPWORDS))
    return F.filter(pieces(F.lower(c), 2), lambda x: ~F.array_contains(stop, x))


def index_terms(c: Column) -> Column:
    """Terms of the full-text index: lower case, accents removed, repeats kept."""
    return pieces(F.translate(F.lower(c), ACCENTED, BASE))


def term_set(c: Column, least: int = 3) -> Column:
    return F.array_distinct(pieces(F.lower(c), least))


def word_set(c: Column) -> Column:
    """Words of three code points or more, ASCII letters lower-cased, as a set."""
    return F.array_distinct(ascii_lower_each(pieces(c, 3)))


def ascii_lower_each(words: Column) -> Column:
    return F.transform(words, ascii_lower)


def stem(term: Column) -> Column:
    """Plural and participle endings cut off; lengths count bytes. The first ending that fits decides."""
    size = F.octet_length(term)
    out = F.when((size > 5) & F.endswith(term, F.lit("ies")), F.concat(F.substring(term, F.lit(1), F.length(term) - 3), F.lit("y")))
    for end in ("ing", "ed", "es", "s"):
        out = out.when((size > len(end) + 3) & F.endswith(term, F.lit(end)), F.substring(term, F.lit(1), F.length(term) - len(end)))
    return out.otherwise(term)


def support_terms(c: Column) -> Column:
    """Terms that a claim must share with its evidence: longer than 2, without stop words, stemmed, as a set."""
    stop = F.array(*(F.lit(w) for w in dims.SUPPORT_STOPWORDS))
    kept = F.filter(F.array_distinct(pieces(F.lower(c), 3)), lambda x: ~F.array_contains(stop, x))  # each word is looked at once
    return F.array_distinct(F.transform(kept, stem))


def similarity(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Jaccard similarity of two sets; ``both_empty`` for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def slug(c: Column) -> Column:
    """Path slug: letters and digits kept, space, dash and underscore to one dash, the rest dropped."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(c), r"[ _-]", "-"), r"[^a-z0-9-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"-{2,}", "-"), r"\A-|-\z", "")


def import_slug(c: Column) -> Column:
    """Document slug: each run of other characters is a dash, at most 80 characters, ``document`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"\A-+|-+\z", "")
    return F.when(s == "", F.lit("document")).otherwise(F.left(s, F.lit(80)))


def catalog_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(ascii_lower(c), r"[^a-z0-9]+", "-"), r"\A-+|-+\z", "")


def normal_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", " "))


def html_to_text(c: Column) -> Column:
    """Scripts and styles go, block tags become line feeds, other tags spaces; six entities are decoded in turn."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(c, r"(?i)</?(p|div|br|li|h[1-6]|section|article)[^>]*>", "\n")
    c = F.regexp_replace(c, r"(?s)<[^>]+>", " ")
    for old, new in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def clean_markdown(c: Column) -> Column:
    c = F.regexp_replace(c, r"\[([^\]]+)\]\([^\)]+\)", "$1")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    return normal_space(F.regexp_replace(c, r"\A[*_`]+|[*_`]+\z", ""))


def truncated(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(most - 3)), F.lit("...")))


def xml_escaped(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def first_date(c: Column) -> Column:
    """Date of an RFC 3339 time or a YYYY-MM-DD day; null for anything else."""
    day = F.when(c.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.expr("true"))
    time = c.rlike(r"\A\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})\z")
    return F.when(day.isNotNull() | time, F.left(c, F.lit(10)).try_cast("date"))


def url_path(c: Column) -> Column:
    """A URL without query and fragment."""
    return F.regexp_extract(c, r"\A[^?#]*", 0)


def clean_reference(c: Column) -> Column:
    return F.trim(F.left(F.regexp_replace(c, r"\p{Cc}", ""), F.lit(260)))


def any_of(c: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(n)) for n in needles))


def normal_tags(tags: Column) -> Column:
    """Tags trimmed, lower case, other characters to single dashes, distinct, at most 20."""
    one = lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"[^a-z0-9]+", "-"), r"\A-+|-+\z", "")
    return F.slice(F.array_distinct(F.filter(F.transform(tags, one), lambda x: x != "")), 1, 20)


def distinct_tags(tags: Column) -> Column:
    """Tags whose lower case has not come before, blanks dropped, first spelling kept."""
    return F.aggregate(
        F.filter(tags, lambda x: F.trim(x) != ""),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: ascii_lower(y) == ascii_lower(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )


_OCTETS = r"(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}\z"
#: How a dotted address of no public network begins: octets below 10 may have a zero before them.
_SPECIAL_V4 = r"\A(?:(?:00?|10|127|22[4-9]|2[345]\d|172\.(?:1[6-9]|2\d|3[01])|192\.168|169\.254|100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])|192\.00?\.0?[02]|198\.1[89]|198\.51\.100|203\.00?\.113)\.)"
#: The same for the eight groups of a version 6 address, lower case; and one that has a version 4 address in its last two groups.
_SPECIAL_V6 = r"\A(?:ff[0-9a-f]{2}|f[cd][0-9a-f]{2}|fe[89ab][0-9a-f]|2001:0?db8):"
_HOLDS_V4 = r"\A(?:0{1,4}:){5}(?:0{1,4}|ffff):"


def is_public_ipv4(c: Column) -> Column:
    """Whether a dotted address is a public one; null if it is none."""
    return F.when(c.rlike(r"\A" + _OCTETS), ~c.rlike(_SPECIAL_V4))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that it may use often: the value is computed once, and the expression stays small."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ipv6_groups(c: Column) -> Column:
    """A version 6 address, compressed, with a dotted tail or neither, as eight groups of lower case digits; null if it is none."""

    def plain(low: Column) -> Column:
        last = F.substring_index(low, ":", -1)
        octets = F.split(last, r"\.")
        pair = lambda k: F.lower(F.hex((F.get(octets, F.lit(k)).try_cast("int") * 256 + F.get(octets, F.lit(k + 1)).try_cast("int")).cast("bigint")))
        dotted = F.contains(low, F.lit(".")) & low.rlike(":" + _OCTETS)
        return F.when(dotted, F.concat(F.substring(low, F.lit(1), F.length(low) - F.length(last)), pair(0), F.lit(":"), pair(2))).otherwise(low)

    def whole(p: Column) -> Column:
        left = F.substring_index(p, "::", 1)
        right = F.substring(p, F.length(left) + 3, F.length(p))
        n = lambda x: F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(":"), F.lit(""))) + 1)
        filled = F.concat(F.when(left != "", F.concat(left, F.lit(":"))).otherwise(""), F.repeat(F.lit("0:"), 7 - n(left) - n(right)), F.lit("0"), F.when(right != "", F.concat(F.lit(":"), right)).otherwise(""))
        return F.when(F.contains(p, F.lit("::")), filled).otherwise(p)

    full = let(let(F.lower(c), plain), whole)
    return let(full, lambda x: F.when(x.rlike(r"\A[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}\z"), x))


def ipv6_segments(c: Column) -> Column:
    """The eight numbers of a version 6 address; null if it is none."""
    return F.transform(F.split(ipv6_groups(c), ":"), lambda y: F.conv(y, 16, 10).cast("int"))


def is_public_ipv6(c: Column) -> Column:
    """Whether a version 6 address is a public one; null if it is none. One that holds a version 4 address is judged by that."""

    def inner(x: Column) -> Column:
        low = F.split(x, ":")
        bytes_ = [F.conv(F.substring(F.lpad(F.get(low, F.lit(k)), 4, "0"), at, 2), 16, 10) for k in (6, 7) for at in (1, 3)]
        return F.concat_ws(".", *bytes_)

    return let(ipv6_groups(c), lambda x: F.when(x.isNotNull(), F.when(x.rlike(_HOLDS_V4), ~inner(x).rlike(_SPECIAL_V4)).otherwise(~x.rlike(_SPECIAL_V6))))


def is_public_address(c: Column) -> Column:
    """Whether an address of either version is a public one; null if it is none."""
    return F.when(F.contains(c, F.lit(":")), is_public_ipv6(c)).otherwise(is_public_ipv4(c))


def safe_relative(c: Column) -> Column:
    """False for an absolute path, or one with a ``..`` part."""
    return ~(F.startswith(c, F.lit("/")) | c.rlike(r"(\A|/)\.\.(/|\z)"))


def text_content_type(c: Column) -> Column:
    return F.startswith(c, F.lit("text/")) | any_of(c, ("application/json", "application/xml", "application/yaml", "application/x-yaml", "application/markdown"))


def numbered_line(c: Column) -> Column:
    """Whether a line begins like an entry of a numbered list."""
    return c.rlike(r"\A[.)]*[0-9][0-9.)]*") & c.rlike(r"\A[^.)]*[.)] ")


def quality(c: Column) -> Column:
    """Struct of text-quality figures, score 0-100 and status of an extracted text."""
    visible = F.length(F.regexp_replace(c, r"[\s\x0B\x85\p{Z}]", ""))
    alnum = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    bad = F.length(F.regexp_replace(c, "[^�]", "")) + F.length(F.regexp_replace(c, r"[^\p{Cc}]|[\n\r\t]", ""))
    # of each run without white space what lies from its first letter or digit to its last
    cores = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}](?:[^\s\x0B\x85\p{Z}]*[\p{L}\p{N}])?"), F.lit(0))
    runs = F.aggregate(
        cores,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda a, x: F.struct(
            F.when(F.length(x) == 1, a["now"] + 1).otherwise(F.lit(0)).alias("now"), F.greatest(a["most"], F.when(F.length(x) == 1, a["now"] + 1).otherwise(F.lit(0))).alias("most")
        ),
        lambda a: a["most"],
    )
    return F.struct(
        visible.alias("visible"), alnum.alias("alnum"), bad.alias("bad"), F.size(cores).alias("tokens"), F.size(F.filter(cores, lambda x: F.length(x) == 1)).alias("singles"), runs.alias("run")
    )


def quality_score(q: Column) -> Column:
    ratio = F.when(q["tokens"] == 0, F.lit(1.0)).otherwise(q["singles"] / q["tokens"])
    many = q["tokens"] >= 12
    less = F.when((q["visible"] < 40) | (q["tokens"] < 8), 65).otherwise(0)
    less += F.when(q["run"] >= 8, 70).when(q["run"] >= 5, 30).otherwise(0)
    less += F.when(many & (ratio > 0.22), 55).when(many & (ratio > 0.12), 20).otherwise(0)
    less += F.when(F.when(q["visible"] == 0, F.lit(0.0)).otherwise(q["alnum"] / q["visible"]) < 0.45, 35).otherwise(0)
    less += F.when(q["bad"] > 0, 30).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - less))


def quality_passed(q: Column) -> Column:
    ratio = F.when(q["tokens"] == 0, F.lit(1.0)).otherwise(q["singles"] / q["tokens"])
    fatal = (q["run"] >= 8) | ((q["tokens"] >= 12) & (ratio > 0.22))
    return (quality_score(q) >= 70) & ~fatal & (q["visible"] >= 40)


#: White space in the sense of Unicode.
BLANK = r"[\s\x0B\x85\p{Z}]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{BLANK}+|{BLANK}+\z", "")


def fetch_refusal(url: Column) -> Column:
    """Why a URL may not be fetched; null for one that may, as far as its text tells."""
    u = F.trim(url)
    authority = F.regexp_extract(u, r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"\A[^@]*@", ""), r":\d*\z", ""))

    def reachable(h: Column) -> Column:
        # a host whose last label is a number is an address; one in another spelling than four octets is not tried
        number = h.rlike(r"(\A|\.)(\d+|0x[0-9a-f]*)\.?\z")
        literal = F.regexp_extract(h, r"\A\[(.*)\]\z", 1)
        return F.when(F.startswith(h, F.lit("[")), F.coalesce(is_public_ipv6(literal), F.lit(False))).when(number, F.coalesce(is_public_ipv4(h), F.lit(False))).otherwise(True)

    public = let(host, reachable)
    return (
        F.when(F.length(u) > 2048, "too long")
        .when(~u.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), "invalid")
        .when(~F.lower(u).rlike(r"\Ahttps?://"), "scheme")
        .when(F.contains(authority, F.lit("@")), "credentials")
        .when(host == "", "no host")
        .when((host == "localhost") | F.endswith(host, F.lit(".localhost")) | ~public, "not public")
    )
