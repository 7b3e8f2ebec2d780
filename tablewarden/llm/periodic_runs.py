"""Periodic runs of words: stretches that repeat one phrase at least four times, found on an enhanced suffix array.

A task numbers the words of a slice of texts and sorts the suffixes by prefix doubling; the text's number leads the first
sort key, so suffixes of different texts never share a prefix. Every maximal repetition of period q ends in a square
whose two halves part exactly behind q words: both halves then lie in one LCP interval of depth q, in different children
("branching"). So, for each LCP interval, the suffixes i of all children but the largest look up whether suffix
i + depth or i - depth lies in the interval too. Squares are rotated to the left as far as the words allow, which gives the
runs; squares of a multiple of a run's period fall into that run. Intervals are index ranges, there are no tree nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.text import Vocabulary, slices, words_of

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
#: Bytes of text whose suffixes are sorted together; a longer text is sorted by itself.
SORT_BYTES = 2 << 20


def suffix_array(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffixes in order, ranks by level): two suffixes have one rank at level k if they agree in 2**k symbols.

    ``owner`` tells which text a symbol belongs to; the last symbol of a text must occur nowhere else in it."""
    n = len(symbols)
    key = owner * (int(symbols.max(initial=0)) + 1) + symbols
    order = np.argsort(key, kind="stable").astype(np.int32)
    ranks, slots, step = [], np.arange(n, dtype=np.int32), 1
    rank, first = np.empty(n, np.int32), np.ones(n, bool)
    first[1:] = key[order[1:]] != key[order[:-1]]
    moved = order
    while True:
        head = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        rank = rank.copy() if ranks else rank
        rank[moved] = head
        ranks.append(rank)
        alone = first & np.append(first[1:], True)
        slots, head = slots[~alone], head[~alone]
        if not len(slots):
            return order, ranks
        moved = order[slots]
        key = head.astype(np.int64) * n + rank[moved + step]
        by = np.argsort(key, kind="stable")
        moved, key = moved[by], key[by]
        order[slots] = moved
        first = np.ones(len(slots), bool)
        first[1:] = key[1:] != key[:-1]
        step *= 2


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Number of symbols that each suffix shares with the one before it in the order."""
    lcp = np.zeros(len(order), np.int64)
    at = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    p, q = order[at - 1].astype(np.int64), order[at].astype(np.int64)
    shared = np.zeros(len(at), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        shared[ranks[level][p + shared] == ranks[level][q + shared]] += 1 << level
    lcp[at] = shared
    return lcp


def nearest_smaller(lcp: np.ndarray, step: int) -> np.ndarray:
    """For each positive entry the place of the next smaller one to the left (step -1) or to the right (step 1).

    Places jump to where their own search has come so far, so that a plateau takes logarithmically many rounds."""
    place = np.arange(len(lcp)) + step
    rest = np.flatnonzero(lcp)
    rest = rest[lcp[place[rest]] >= lcp[rest]]
    while len(rest):
        place[rest] = place[place[rest]]
        rest = rest[lcp[place[rest]] >= lcp[rest]]
    return place


def branching_squares(order: np.ndarray, lcp: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, half length) of the squares whose halves part right behind their length. ``words`` is the number of words
    of each symbol's text: half lengths of which four don't fit into the text are left out, as are intervals with fewer
    suffixes than a run of that period has."""
    lcp = np.append(lcp, 0)
    left, right = nearest_smaller(lcp, -1), nearest_smaller(lcp, 1)
    at = np.flatnonzero(lcp)
    depth = lcp[at]
    most = words[order[np.minimum(at, len(order) - 1)]]
    size = right[at] - left[at]
    at = at[(depth * LEAST_PERIODS <= most) & (size >= np.where(depth == 1, LEAST_WORDS, LEAST_PERIODS))]
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    by = np.lexsort((at, right[at], left[at]))
    at = at[by]
    low, high, depth = left[at], right[at], lcp[at]
    opens = np.ones(len(at), bool)
    opens[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    closes = np.append(opens[1:], True)
    # the children of an interval lie between its places of least LCP; the last one is behind the last such place
    start = np.concatenate([np.where(opens, low, np.append(0, at[:-1])), at[closes]])
    end = np.concatenate([at, high[closes]])
    interval = np.cumsum(opens) - 1
    interval = np.concatenate([interval, interval[closes]])
    low, high, depth = low[opens], high[opens], depth[opens]
    by = np.lexsort((start, start - end, interval))
    largest = np.ones(len(by), bool)
    largest[1:] = interval[by][1:] != interval[by][:-1]
    small = by[~largest]
    start, end, interval = start[small], end[small], interval[small]
    counts = end - start
    child = np.repeat(np.arange(len(small)), counts)
    index = np.arange(len(child)) - np.repeat(np.cumsum(counts) - counts, counts) + start[child]
    suffix, half = order[index].astype(np.int64), depth[interval[child]]
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.arange(len(order))
    found = []
    for other in (suffix + half, suffix - half):
        where = inverse[np.clip(other, 0, len(order) - 1)]
        inside = (other >= 0) & (where >= low[interval[child]]) & (where < high[interval[child]])
        inside &= (where < start[child]) | (where >= end[child])
        found.append((np.minimum(suffix, other)[inside], half[inside]))
    start, half = (np.concatenate(x) for x in zip(*found, strict=True))
    once = np.unique(start * (int(half.max(initial=0)) + 1) + half)
    return np.divmod(once, int(half.max(initial=0)) + 1)


def long_enough(start: np.ndarray, half: np.ndarray, ranks: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """Which squares end a stretch of their period with enough words: two overlapping blocks of a power of two compare
    the stretch with itself, moved by the period. ``first`` is the place of the first word of each symbol's text."""
    least = np.maximum(LEAST_WORDS, LEAST_PERIODS * half)
    begin = start + 2 * half - least
    fits = begin >= first[start]
    level = np.frexp((least - half).astype(np.float64))[1] - 1
    fits &= level < len(ranks)
    table = np.stack(ranks)
    i = np.flatnonzero(fits)
    begin, last, level = begin[i], start[i] + half[i], level[i]
    last = last - (1 << level)
    same = (table[level, begin] == table[level, begin + half[i]]) & (table[level, last] == table[level, last + half[i]])
    return i[same]


def rotated(symbols: np.ndarray, start: int, half: int, first: int) -> int:
    """How far to the left a square at ``start`` can be rotated, down to ``first``."""
    step = 64
    while start > first:
        low = max(first, start - step)
        other = np.flatnonzero(symbols[low:start] != symbols[low + half : start + half])
        if len(other):
            return low + int(other[-1]) + 1
        start, step = low, 2 * step
    return start


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each sequence of words, by start and period."""
    vocabulary = Vocabulary()
    look = vocabulary.__getitem__
    counts = np.array([len(words) for words in texts], np.int64)
    if not counts.sum():
        return [[] for _ in texts]
    firsts = np.cumsum(counts + 1) - counts - 1
    symbols = np.zeros(int((counts + 1).sum()), np.int64)  # each text ends with a 0
    for words, first in zip(texts, firsts.tolist(), strict=True):
        symbols[first : first + len(words)] = np.fromiter(map(look, words), np.int64, len(words)) + 1
    owner = np.repeat(np.arange(len(texts)), counts + 1)
    order, ranks = suffix_array(symbols, owner)
    start, half = branching_squares(order, common_prefixes(order, ranks), counts[owner])
    chosen = long_enough(start, half, ranks, firsts[owner])
    start, half = start[chosen], half[chosen]
    end = start + 2 * half
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    last, here = -1, []
    for k in np.lexsort((half, end)).tolist():
        s, q, e = int(start[k]), int(half[k]), int(end[k])
        if e != last:
            last, here = e, []
        if any(q % period == 0 and s >= begin for begin, period in here):
            continue  # a square of several periods of a run that ends here
        first = int(firsts[owner[s]])
        begin = rotated(symbols, s, q, first)
        here.append((begin, q))
        found[owner[s]].append((begin - first, e - begin, q))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside of runs, and the first period of each run where no other run drops it."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept)]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """doc_id, n_words, runs, collapsed: every periodic run of every whole text, and the text without the repeats.

    Words are ``[^\\x20\\x09-\\x0D]+`` of ``text`` (by default column ``text``), numbered from 0. A run is a stretch of
    words with smallest period q, of at least max(6, 4 q) words, that can't be extended; ``runs`` holds (start, length,
    period) by start, then period. ``collapsed`` joins by one space the words that no run contains behind its first q
    words. One row per row of ``docs``, repeated rows as often as they occur; null and empty texts have no words, no runs
    and an empty collapsed text. Other columns of ``docs`` don't matter. Nothing is shuffled; memory is linear in the
    longest text, and no length is refused.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.col("text") if text is None else text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(1), SORT_BYTES):
                words = [words_of(t) for t in part]
                runs = runs_of(words)
                flat = [r for found in runs for r in found]
                fields = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
                ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
                structs = pa.StructArray.from_arrays(fields, names=["start", "length", "period"])
                joined = [b" ".join(without_repeats(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(words, runs, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(map(len, words), pa.int64()), pa.ListArray.from_arrays(ends, structs), pa.array(joined, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )
                at += len(part)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def with_planted_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text of a row, in one of ten rows (crc32 of the id as text) with its tail replaced by repeats of a phrase.

    With h the hash, g = h div 10 and n words, each word from a = g mod n on becomes word a + (i - a) mod p, where
    p = 1 + (n - a) div (3 + g mod 8). Rows without an id, null texts and texts without words stay as they are."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(F.col(text_col), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.element_at(words, (a + F.pmod(i - a, p) + 1).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " "))

    # the array of one element binds the words to a variable, or each use would split the text again
    changed = F.when(F.coalesce(h % 10 == 0, F.lit(False)), F.get(F.transform(F.array(words), repeated), 0))
    return F.coalesce(changed, F.col(text_col))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (nulls without one) and SHA-256 of the list of runs and of the collapsed text."""
    best = F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], F.signum(b["length"] - a["length"])).when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"])).cast("int"))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", F.get(best, 0)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
