"""URL filter: host rules, then a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

The filter has blocks of 256 bits (four longs); a key touches one block, with two bits in each of its longs. A URL
whose bits are all set is a possible hit; only those go to the exact join with the list, which removes the false
positives. All of it is DataFrame expressions and joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with its subdomains, below a path prefix."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


def host_column(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_column(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_column(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or default port, and the path without closing slashes."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    return F.when(host == "", F.lit("")).otherwise(F.concat(bare, F.regexp_replace(path, r"/+$", "")))


def rule_column(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name of the longest rule that fits, else null. The list is part of the plan, so it is meant for some hundreds
    of rules; whole blocklists go to ``listed``."""
    out: Column | None = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        out = F.when(fits, F.lit(rule.name)) if out is None else out.when(fits, F.lit(rule.name))
    return F.lit(None).cast("string") if out is None else out


def _bits(key: Column) -> list[Column]:
    spread = F.xxhash64(key, F.lit("bits"))
    place = [F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(8)]
    return [_bit(place[i]).bitwiseOR(_bit(place[i + 4])) for i in range(4)]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks)).cast("long")


def bloom_blocks(listed: DataFrame, key: str, n: int, bits_per_key: int = 12) -> tuple[DataFrame, int]:
    """The filter as a table (block, w0..w3) and its number of blocks."""
    blocks = max(1, -(-n * bits_per_key // 256))
    words = listed.select(_block(F.col(key), blocks).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(_bits(F.col(key)))])
    return words.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)]), blocks


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    listed_url_col: str = "url",
    bits_per_key: int = 12,
    broadcast_bytes: int = 16 << 20,
    salts: int = 8,
) -> DataFrame:
    """Judges every URL: page_id, host, path, rule, verdict, possible, listed.

    A fitting rule decides; else a URL whose canonical form is in ``listed`` is blocked, every other one allowed.
    ``possible`` says that the Bloom filter let it through to the exact join. A null URL, or one without ``://``, has
    empty host and path, fits no rule and is allowed. Each input row gives one row, repeated rows included; entries of
    the list without a host are ignored; an empty list blocks nothing. The Bloom table is broadcast only if its
    computed size is within ``broadcast_bytes``, else joined by block. A canonical URL that many pages share is
    joined in ``salts`` parts, with the filter and with the list. Of rules that fit with equal length the first in
    order of name decides; a very long URL is judged whole.
    """
    host, path = host_column(F.col(url_col)), path_column(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.select(
        "*",
        rule_column(F.col("host"), F.col("path"), rules).alias("rule"),
        canonical_column(F.col("host"), F.col("path")).alias("key"),
    )
    source = F.col(listed_url_col)
    keys = listed.select(canonical_column(host_column(source), path_column(source)).alias("key"))
    keys = keys.where("key <> ''").distinct()
    filter_table, blocks = bloom_blocks(keys, "key", keys.count(), bits_per_key)
    probes, on = rows.withColumn("block", _block(F.col("key"), blocks)), ["block"]
    if blocks * 40 <= broadcast_bytes:
        filter_table = F.broadcast(filter_table)
    else:
        filter_table = filter_table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        probes, on = probes.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int")), ["block", "salt"]
    words = _bits(F.col("key"))
    hit = F.lit(True)
    for i, word in enumerate(words):
        hit = hit & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(word) == word)
    probed = probes.join(filter_table, on, "left")
    probed = probed.select("page_id", "host", "path", "rule", "key", hit.alias("possible"))

    hits = probed.where("possible").withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int"))
    wanted = hits.select("key").distinct().join(keys, "key", "left_semi")
    wanted = wanted.select("key", F.lit(True).alias("listed"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    hits = hits.join(wanted, ["key", "salt"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    columns = ["page_id", "host", "path", "rule", "possible", "listed"]
    out = hits.select(columns).unionByName(probed.where("NOT possible").withColumn("listed", F.lit(False)).select(columns))
    verdict = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    for rule in {r.name: r for r in rules}.values():
        verdict = F.when(F.col("rule") == rule.name, F.lit(rule.verdict)).otherwise(verdict)
    return out.withColumn("verdict", verdict)
