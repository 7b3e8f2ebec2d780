"""Partition keys as column expressions: time to key, key to bounds, validity, several dimensions in one key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("hourly", "daily", "weekly", "monthly", "yearly")
FORMATS = {"hourly": "yyyy-MM-dd HH:00:00", "daily": "yyyy-MM-dd", "monthly": "yyyy-MM", "yearly": "yyyy"}
SHAPES = {
    "hourly": r"^\d{4}-\d{2}-\d{2}[ T]\d{2}(:00:00)?$",
    "daily": r"^\d{4}-\d{2}-\d{2}$",
    "weekly": r"^\d{4}-W\d{2}$",
    "monthly": r"^\d{4}-\d{2}$",
    "yearly": r"^\d{4}$",
}
STEPS = {"hourly": "INTERVAL 1 HOUR", "daily": "INTERVAL 1 DAY", "weekly": "INTERVAL 7 DAY", "monthly": "INTERVAL 1 MONTH", "yearly": "INTERVAL 1 YEAR"}


def _grain(grain: str) -> str:
    if grain not in GRAINS:
        raise ValueError(f"unknown grain: {grain}")
    return grain


def partition_key(ts: Column, grain: str) -> Column:
    """``yyyy-MM-dd HH:00:00``, ``yyyy-MM-dd``, ISO ``YYYY-Www``, ``yyyy-MM`` or ``yyyy``."""
    if _grain(grain) == "weekly":
        day = ts.cast("date")
        return F.when(day.isNotNull(), F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day)))
    return F.date_format(ts, FORMATS[grain])


def key_start(key: Column, grain: str) -> Column:
    """First moment of a key, null for a text that is no key. Hours may be written with a space or a ``T``; a week may
    also be its Monday's date."""
    if _grain(grain) == "weekly":
        year, week = key.substr(1, 4).try_cast("int"), key.substr(7, 2).try_cast("int")
        fourth = F.make_date(year, F.lit(1), F.lit(4))  # always in ISO week 1
        monday = F.date_add(fourth, (week - 1) * 7 - F.weekday(fourth))
        iso = F.when((week >= 1) & (F.extract(F.lit("YEAROFWEEK"), monday) == year), monday)
        day = key.try_cast("date")
        return F.when(key.rlike(SHAPES["weekly"]), iso).when(key.rlike(SHAPES["daily"]) & (F.weekday(day) == 0), day).cast("timestamp_ntz")
    text = {
        "hourly": F.concat(F.translate(key.substr(1, 13), "T", " "), F.lit(":00:00")),
        "daily": key,
        "monthly": F.concat(key, F.lit("-01")),
        "yearly": F.concat(key, F.lit("-01-01")),
    }[grain]
    return F.when(key.rlike(SHAPES[grain]), text.try_cast("timestamp_ntz"))


def key_end(key: Column, grain: str) -> Column:
    """First moment after a key."""
    return key_start(key, grain) + F.expr(STEPS[grain])


def valid_key(key: Column, grain: str, low: str | None = None, high: str | None = None) -> Column:
    """Whether a text is a key of that grain, and (in text order) at least ``low`` and below ``high``."""
    ok = key_start(key, grain).isNotNull()
    ok = ok if low is None else ok & (key >= low)
    return F.coalesce(ok if high is None else ok & (key < high), F.lit(False))


def shift_key(key: Column, grain: str, n: int | Column) -> Column:
    """The key ``n`` steps later (earlier if negative)."""
    n = F.lit(n) if isinstance(n, int) else n
    start = key_start(key, grain)
    if grain == "monthly":
        start = F.add_months(start.cast("date"), n)
    elif grain == "yearly":
        start = F.add_months(start.cast("date"), n * 12)
    elif grain == "hourly":
        start = start + F.make_dt_interval(hours=n)
    else:
        start = F.date_add(start.cast("date"), n * (7 if grain == "weekly" else 1))
    return partition_key(start, grain)


def multi_key(**dimensions: Column) -> Column:
    """Several dimensions as one JSON text, names sorted."""
    return F.to_json(F.struct(*[dimensions[n].cast("string").alias(n) for n in sorted(dimensions)]))


def dimensions(key: Column) -> Column:
    """The map behind ``multi_key``; a text that is no JSON object gives a map with the entry ``default``."""
    parsed = F.from_json(key, "map<string,string>", {"mode": "PERMISSIVE"})
    return F.when(F.startswith(key, F.lit("{")), parsed).otherwise(F.create_map(F.lit("default"), key))


def dimension(key: Column, name: str) -> Column:
    return F.try_element_at(dimensions(key), F.lit(name))
