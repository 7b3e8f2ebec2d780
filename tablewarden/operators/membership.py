"""Which rows may have their key in another table: a filter of bits that a scan can apply before anything is shuffled.

Every key of the reference sets three bits in one of eight 64-bit words of a block; a row whose bits aren't all set has no
partner for certain, so only possible partners, and about one in a hundred others, go into the exact join behind it. The
blocks are broadcast: their number follows the number of keys, up to a fixed most; beyond, the filter fills up and lets
more rows through, but it never grows further and never loses one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
#: Blocks of 64 bytes that are broadcast at most, about 50 MB with the keys of the hash table: 16 million keys at 16 bits.
MOST_BLOCKS = 1 << 19
KEYS_A_BLOCK = 32


def _place(keys: list[Column], blocks: int) -> tuple[Column, Column, Column]:
    """(block, number of the word from 1, bits) of a key."""
    h = F.xxhash64(*keys, F.lit("member"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftrightunsigned(h, 18).bitwiseAND(F.lit(WORDS - 1)).cast("int") + 1
    return F.pmod(F.shiftrightunsigned(h, 21), F.lit(blocks)).cast("long"), word, bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))


def member_blocks(reference: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    """(block, words) of the keys of ``reference``."""
    block, word, bits = _place([F.col(k) for k in keys], blocks)
    placed = reference.select(block.alias("block"), word.alias("word"), bits.alias("bits"))
    words = [F.bit_or(F.when(F.col("word") == i + 1, F.col("bits")).otherwise(F.lit(0).cast("long"))) for i in range(WORDS)]
    return placed.groupBy("block").agg(F.array(*words).alias("words"))


def blocks_for(n_keys: int) -> int:
    return max(1, min(MOST_BLOCKS, -(-n_keys // KEYS_A_BLOCK)))


def with_possible(df: DataFrame, keys: list[Column], reference: DataFrame, ref_keys: list[str], name: str, n_keys: int | None = None) -> DataFrame:
    """Adds the boolean column ``name``: false where no row of ``reference`` has the row's keys. Null keys are keys like any
    other here; the exact join decides. ``n_keys`` is the number of rows of ``reference`` if it is known."""
    blocks = blocks_for(reference.count() if n_keys is None else n_keys)
    kinds = [f.dataType for f in df.select(*keys).schema]  # equal numbers of different types have different hashes
    reference = reference.select(*[F.col(k).try_cast(t).alias(k) for k, t in zip(ref_keys, kinds, strict=True)])
    table = member_blocks(reference, ref_keys, blocks).select(F.col("block").alias("_block"), "words")
    block, word, bits = _place(keys, blocks)
    joined = df.withColumns({"_block": block, "_word": word, "_bits": bits}).join(F.broadcast(table), "_block", "left")
    hit = F.col("words")[F.col("_word") - 1].bitwiseAND(F.col("_bits")) == F.col("_bits")
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_block", "_word", "_bits", "words")


def possible(df: DataFrame, keys: list[Column], reference: DataFrame, ref_keys: list[str], n_keys: int | None = None) -> DataFrame:
    """The rows whose keys may be in ``reference``."""
    return with_possible(df, keys, reference, ref_keys, "_possible", n_keys).where("_possible").drop("_possible")
