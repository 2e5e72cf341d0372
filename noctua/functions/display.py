"""How figures, times and states are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tones of states and risks.
STATUS_TONE = {"running": "accent", "waiting_for_tool": "accent", "resuming": "accent", "verifying": "accent", "waiting_for_approval": "warning", "completed": "success", "failed": "danger"}
RISK_TONE = {"low": "neutral", "medium": "warning", "high": "danger", "critical": "danger"}


def compact(number: Column) -> Column:
    """A number with thousands separators, or in K, M, B with one decimal from 10 000 on."""
    short = lambda by, unit: F.concat(F.regexp_replace(F.format_string("%.1f", F.round(number / by, 1)), r"\.0\z", ""), F.lit(unit))
    whole = F.regexp_replace(F.format_number(F.round(number.cast("double"), 1), 1), r"\.0\z", "")
    return F.when(number >= 999_950_000, short(1e9, "B")).when(number >= 999_950, short(1e6, "M")).when(number >= 10_000, short(1e3, "K")).otherwise(whole)


def relative(seconds: Column) -> Column:
    """Words for a time so many seconds from now; the past is negative."""
    size = F.abs(seconds)
    count = F.when(size < 3600, F.floor(seconds / 60 + 0.5)).when(size < 86_400, F.floor(seconds / 3600 + 0.5)).otherwise(F.floor(seconds / 86_400 + 0.5))
    unit = F.when(size < 3600, "minute").when(size < 86_400, "hour").otherwise("day")
    many = F.concat(F.abs(count).cast("string"), F.lit(" "), unit, F.when(F.abs(count) == 1, "").otherwise("s"))
    day = F.when((unit == "day") & (count == -1), "yesterday").when((unit == "day") & (count == 1), "tomorrow")
    return F.when(size < 60, "just now").otherwise(F.coalesce(day, F.when(count < 0, F.concat(many, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), many))))


def status_tone(status: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in STATUS_TONE.items() for x in kv)), status), F.lit("neutral"))


def status_label(status: Column) -> Column:
    words = F.replace(status, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, F.lit(2), F.length(words)))


def risk_tone(risk: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in RISK_TONE.items() for x in kv)), risk)
