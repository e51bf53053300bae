"""Runs of words that repeat with a period, caught online as squares.

Words arrive at a catcher in order. Over every completed block of 2^k words that begins at a multiple of 2^k stands a
catcher for squares whose first half holds that block: it watches the words at distances of 2^(k+1) - 1 to 2^(k+2) - 2
for a copy of its block. As any stretch of 2^(k+1) - 1 words holds such a block, every period has its level. A
copy starts a suffix comparison at its distance: back to where the square began, and on with each word that is appended
until one differs. Squares of one period that touch are one run; a square inside a run of a divisor of its period is
that run and starts nothing. Every word meets two catchers a level, so the work is that of n log n words at most.

Words are numbered exactly (no hashes); blocks are found by hash and compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.blocks import block_columns
from tidewatch.llm.common import mix, table

CHUNK = 1 << 16  # words that are appended at a time
WORDS_HELD = 400_000  # distinct words that are numbered before numbers start anew
RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())]), False)
LEFT, RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class SquareCatcher:
    """Runs of a stream of numbered words with length >= exponent * period; found is (start, end, period), in no order."""

    def __init__(self, exponent: int, longest: int) -> None:
        self.exponent = exponent
        self.words = np.zeros(0, np.int64)
        self.levels = 0
        while exponent * ((2 << self.levels) - 1) <= longest:  # the level's smallest period fits
            self.levels += 1
        self.names = [np.zeros(0, np.uint64) for _ in range(self.levels)]  # hash of the 2^k words from each place on
        self.first = [0] * self.levels  # place of the first name that is still kept
        self.live: dict[int, int] = {}  # period -> start of the stretch that has it up to the last word
        self.found: list[tuple[int, int, int]] = []

    def append(self, new: np.ndarray) -> None:
        at = len(self.words)
        self.words = np.concatenate([self.words, new])
        closed: dict[int, list[tuple[int, int]]] = {}
        for period, start in list(self.live.items()):
            end = self.reach(at, period)
            if end < len(self.words):
                self.close(period, start, end)
                closed.setdefault(period, []).append((start, end))
                del self.live[period]
        for k in range(self.levels):
            self.name(k, at)
            self.catch(k, at, closed)
        for k in range(self.levels):  # after the loop, as a level is named from the one below
            self.forget(k)

    def finish(self) -> list[tuple[int, int, int]]:
        for period, start in self.live.items():
            self.close(period, start, len(self.words))
        self.live.clear()
        best: dict[tuple[int, int], int] = {}
        for start, end, period in self.found:  # a multiple of a period has the same stretch
            best[start, end] = min(period, best.get((start, end), period))
        return [(start, end, period) for (start, end), period in best.items()]

    def close(self, period: int, start: int, end: int) -> None:
        if end - start >= self.exponent * period:
            self.found.append((start, end, period))

    def reach(self, at: int, period: int) -> int:
        """The first place from at on whose word is not the one a period before; the end of the words if there is none."""
        step, n = 64, len(self.words)
        while at < n:
            to = min(n, at + step)
            differ = np.flatnonzero(self.words[at:to] != self.words[at - period : to - period])
            if len(differ):
                return at + int(differ[0])
            at, step = to, step * 4
        return n

    def back(self, at: int, period: int) -> int:
        """The first place of the stretch before at whose words are those a period before."""
        step = 64
        while at > period:
            to = max(period, at - step)
            differ = np.flatnonzero(self.words[to:at] != self.words[to - period : at - period])
            if len(differ):
                return to + int(differ[-1]) + 1
            at, step = to, step * 4
        return at

    def name(self, k: int, at: int) -> None:
        n = len(self.words)
        begin = self.first[k] + len(self.names[k])
        if k == 0:
            new = mix(self.words[begin:].astype(np.uint64) + np.uint64(1))
        else:
            half = 1 << (k - 1)
            low, a = self.names[k - 1], begin - self.first[k - 1]
            count = max(0, n - 2 * half + 1 - begin)
            new = mix(low[a : a + count] * LEFT + low[a + half : a + half + count] * RIGHT)
        self.names[k] = np.concatenate([self.names[k], new]) if len(self.names[k]) else new

    def forget(self, k: int) -> None:
        """Drops names that no later word can meet."""
        keep = max(0, len(self.words) - (6 << k))
        if keep - self.first[k] > CHUNK:
            self.names[k] = self.names[k][keep - self.first[k] :].copy()
            self.first[k] = keep

    def catch(self, k: int, at: int, closed: dict[int, list[tuple[int, int]]]) -> None:
        size, n, names, first = 1 << k, len(self.words), self.names[k], self.first[k]
        i = np.arange(max(2 * size - 1, at - size + 1), n - size + 1)  # windows that end in the new words
        if not len(i):
            return
        block = (i - (2 * size - 1)) // size * size  # the two completed blocks at the level's distances
        own = names[i - first]
        near = np.flatnonzero(names[block - first] == own)
        block -= size
        far = np.flatnonzero((block >= 0) & (names[np.maximum(block, first) - first] == own))
        if not len(near) and not len(far):
            return
        known = [(p, s, n) for p, s in self.live.items()] + [(p, s, e) for p, ends in closed.items() for s, e in ends]
        known += [(p, s, e) for s, e, p in self.found if e > at]
        known = [x for x in known if x[2] - x[1] >= 3 * size - 1]
        copies, periods = [], []
        for some, blocks in ((i[near], block[near] + size), (i[far], block[far])):
            apart, keep = some - blocks, np.ones(len(some), bool)
            for period, start, end in known:  # squares in a run of a divisor of their period
                a, b = np.searchsorted(some, start), np.searchsorted(some, end - size, "right")
                if a < b:
                    keep[a:b] &= (blocks[a:b] < start) | (apart[a:b] % period != 0)
            copies.append(some[keep])
            periods.append(apart[keep])
        copies, periods = np.concatenate(copies), np.concatenate(periods)
        if not len(copies):
            return
        order = np.lexsort((copies, periods))
        copies, periods = copies[order], periods[order]
        apart = np.flatnonzero((np.diff(periods) != 0) | (np.diff(copies) != size)) + 1
        begins, ends = np.concatenate([[0], apart]), np.concatenate([apart, [len(copies)]])
        period, begin, end = periods[begins], copies[begins], copies[ends - 1] + size
        long = (end - begin + 2 * (size - 1) >= (self.exponent - 1) * period) | (end + size > n)  # long enough, or still growing
        for p, a, b in zip(period[long].tolist(), begin[long].tolist(), end[long].tolist(), strict=True):
            self.start(p, a, b, size)

    def start(self, period: int, begin: int, end: int, size: int) -> None:
        """A suffix comparison at this distance from the copies words[begin:end] of blocks."""
        if not np.array_equal(self.words[begin:end], self.words[begin - period : end - period]):
            if end - begin > size:  # blocks of equal hash and different words: each on its own
                for a in range(begin, end, size):
                    self.start(period, a, a + size, size)
            return
        start = self.back(begin, period) - period
        if period in self.live and self.live[period] <= start:
            return
        end = self.reach(end, period)
        if end == len(self.words):
            self.live[period] = start
        else:
            self.close(period, start, end)


class Numbers(dict):
    """Word -> number, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def runs_of(texts: Iterable[list[bytes]], exponent: int, least: int, numbers: Numbers) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start, then period.

    Short lists are one stream with a word of its own between them, so that no run crosses; long ones are appended by chunks.
    """
    texts = list(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((i for i, t in enumerate(texts) if len(t) >= max(least, exponent)), key=lambda i: len(texts[i]))
    group: list[int] = []
    held = 0
    groups = []
    for i in order:
        if group and held + len(texts[i]) > CHUNK:
            groups.append(group)
            group, held = [], 0
        group.append(i)
        held += len(texts[i]) + 1
    for group in [*groups, *([group] if group else [])]:
        if len(numbers) > WORDS_HELD:
            numbers.clear()
        starts, parts, at = [], [], 0
        for j, i in enumerate(group):
            parts += [np.fromiter(map(numbers.__getitem__, texts[i]), np.int64, len(texts[i])), np.array([-2 - j])]
            starts.append(at)
            at += len(texts[i]) + 1
        stream = np.concatenate(parts)
        catcher = SquareCatcher(exponent, max(len(texts[i]) for i in group))
        for a in range(0, len(stream), CHUNK):
            catcher.append(stream[a : a + CHUNK])
        for start, end, period in catcher.finish():
            if end - start >= least:
                j = int(np.searchsorted(starts, start, "right")) - 1
                out[group[j]].append((start - starts[j], end - start, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, text: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """docs with n_words, runs (array of start, length, period, by start, then period) and collapsed, the text without repeats.

    Words are [^ \\t-\\r]+ of the whole text, numbered from 0. A run is a stretch of words with smallest period q, of
    at least exponent * q and least words, that no word on either side extends with that period. collapsed holds the
    words that no run has after its first q, joined by one space. Null, empty and blank texts have no words, no runs and
    an empty collapsed. Runs that overlap or tie are all listed. Own columns of these names are replaced; rows are
    neither joined nor reordered, so repeated rows, null ids and empty tables need no care; long texts are read whole.
    """
    if exponent < 2:
        raise ValueError("exponent has to be 2 at least")
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        numbers = Numbers()

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            words = [t.split() if t else [] for t in batch.column(text).cast(pa.binary()).to_pylist()]
            runs = runs_of(words, exponent, least, numbers)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            listed = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs], kind)
            return [pa.array(map(len, words), pa.int64()), listed, pa.array(map(collapse, words, runs), pa.binary()).cast(pa.string())]

        return each

    return block_columns(docs, text, fields, make)


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period; of ties the first of the list. Null without runs."""
    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.reduce(runs, nothing, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """documents with a tail that repeats in every tenth text, by the checksum of the id: the query's own rule."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n = F.floor(h / 10), F.size(words)
    a = F.pmod(g, n).cast("int")
    left = n - a
    p = (1 + F.floor(left / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil(left / p).cast("int"))), F.lit(1), left)
    text = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return docs.withColumn("text", F.when((h % 10 == 0) & (n > 0), text).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = strongest(F.col("runs"))
    found = periodic_runs(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), "runs", "collapsed")
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
