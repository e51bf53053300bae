"""Repeated byte strings across documents by a common-prefix-aware distributed merge sort.

Only suffixes that can matter are sorted. Each string of `length` bytes is anchored at the smallest hash
among its 20-byte pieces, so equal strings are anchored alike, and neighbouring strings of one anchor form
a phrase. Anchors that one document alone has are dropped.

A phrase is written from its anchor: the bytes from the anchor on, then the bytes before it backwards.
Each task sorts its distinct phrases into front-coded runs (shared prefix length, rest); runs are exchanged
by ranges and merged with loser trees that compare two phrases only beyond the prefix that both are known
to share with the last one given out. Repeats are read off the merged common prefixes: phrases that follow
each other with a common prefix of k bytes share every string that ends within k bytes of the anchor and
has the same bytes before it, and the smallest document of each string is found there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc  # by a name of its own, which goes with a function to a new Python worker
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import BASE, BROADCAST_ROWS, map_batches, mix, prefix_hash, settle, slices, span_hash, table, texts_of, written

LENGTH, PIECE = 50, 20
#: Bits of the filter of shared anchors, in 2^16 blocks: a broadcast of 16 MB, and of 64 MB for texts of over LARGE bytes
#: in all. Where it fills up (hundreds of millions of shared anchors) more phrases are sorted, with the same result.
BITS, LARGE_BITS, LARGE = 27, 29, 4 << 30
PART_BYTES = 16 << 20  # of text for each range of the exchange
CHUNK = 1 << 22  # bytes of one text that are anchored at once
RUN_PHRASES, RUN_ANCHORS = 150_000, 1_000_000
SAMPLE_MASK = 0x3FF  # anchors whose hash ends in ten zero bits give the borders of the ranges
PAIRWISE = 16  # phrases of one anchor that are held against each other
GROUP_PHRASES = 50_000  # phrases of one anchor that a task resolves itself; the strings of more are grouped by Spark
OUT_ROWS = 20_000  # rows that a task holds before it gives them out


def phrases(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """text, anchor, first and last string start, anchor hash and phrase hash of each phrase, places within data."""
    if len(offsets) == 2 and len(data) > CHUNK + length:  # one long text: the strings that start in each of its pieces
        found = []
        for a in range(0, len(data) - length + 1, CHUNK):
            part = data[a : a + CHUNK + length - 1]
            text, anchor, first, last, hashes, content = _phrases(part, np.array([0, len(part)]), length)
            found.append((text, anchor + a, first + a, last + a, hashes, content))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    return _phrases(data, offsets, length)


def _phrases(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    n, width = len(data), length - PIECE + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix, down = prefix_hash(data)
    m = n - PIECE + 1
    pieces = mix((prefix[PIECE:] - prefix[:m]) * down[:m])
    value, place = (pieces >> np.uint64(32)).astype(np.uint32), np.arange(m, dtype=np.int32)
    step, reach = 1, 1
    while reach < width:  # smallest of `reach` neighbours, the leftmost of equals
        step = min(reach, width - reach)
        left = value[:-step] <= value[step:]
        value, place = np.where(left, value[:-step], value[step:]), np.where(left, place[:-step], place[step:])
        reach += step
    sizes = np.diff(offsets)
    room = np.repeat(offsets[1:], sizes)[: n - length + 1] - np.arange(n - length + 1)
    start = np.flatnonzero(room >= length)
    if not len(start):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = place[start]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(start) != 1)]))
    first, last, anchor = start[new], start[np.append(new[1:], len(start)) - 1], anchor[new].astype(np.int64)
    text = np.searchsorted(offsets, first, "right") - 1
    content = span_hash(prefix, down, first, last + length) ^ mix((anchor - first).astype(np.uint64) + np.uint64(1))
    # The smallest of many hashes is small: mixed again, anchors spread evenly over filter and parts.
    return text, anchor, first, last, mix(pieces[anchor] ^ BASE) >> np.uint64(16), content


def six(hashes: np.ndarray) -> bytes:
    """48-bit hashes as six bytes each."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unsix(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def filter_bits(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Three bits for each hash, all in the block that its first 16 bits name."""
    block = (hashes >> np.uint64(32)).astype(np.int64) << (bits - 16)
    for shift in (21, 10, 0):
        yield block + ((hashes >> np.uint64(shift)).astype(np.int64) & ((1 << (bits - 16)) - 1))


def shared_anchors(docs: DataFrame, key: str, text: str, length: int, parts: int, size: int) -> tuple[np.ndarray, list[bytes]]:
    """A filter of 2^size bits that has every anchor of two documents or more, and range borders.

    Tasks send the distinct anchors of their documents, six bytes each; a range of anchors gives a part of the
    filter of its own.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, base, samples = [], 0, 0, {}

        def flush() -> Iterator[pa.RecordBatch]:
            anchors, docs_ = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((docs_, anchors))
            anchors, docs_ = anchors[order], docs_[order]
            new = np.concatenate([[True], anchors[1:] != anchors[:-1]])
            at = np.flatnonzero(new)
            many = np.maximum.reduceat(docs_, at) != docs_[at]
            anchors = anchors[at]
            part = ((anchors >> np.uint64(32)).astype(np.int64) * parts) >> 16
            cut = np.searchsorted(part, np.arange(parts + 1))
            rows = []
            for p in range(parts):
                own, flag = anchors[cut[p] : cut[p + 1]], many[cut[p] : cut[p + 1]]
                if len(own):
                    some = {int(a): samples[int(a)] for a in own[(own & np.uint64(SAMPLE_MASK)) == 0]}
                    rows.append((p, six(own[~flag]), six(own[flag]), b"".join(a.to_bytes(6, "little") + s for a, s in some.items())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "ones", "many", "sample"])

        for batch in batches:
            data, offsets = texts_of(batch.column(text))
            for a, b in slices(offsets):
                part = data[offsets[a] : offsets[b]]
                doc, anchor, _, _, hashes, _ = phrases(part, offsets[a : b + 1] - offsets[a], length)
                if len(doc):
                    held.append((hashes, (doc + base).astype(np.int64)))
                    count += len(doc)
                    for i in np.flatnonzero((hashes & np.uint64(SAMPLE_MASK)) == 0):
                        samples[int(hashes[i])] = part[anchor[i] : anchor[i] + PIECE].tobytes()
                base += b - a
                if count >= RUN_ANCHORS:
                    yield from flush()
                    held, count, samples = [], 0, {}
        if held:
            yield from flush()

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        p = int(group["part"].iloc[0])
        many = unsix(b"".join(group["many"]))
        every = np.sort(np.concatenate([unsix(b"".join(group["ones"])), many]))
        shared = np.unique(np.concatenate([many, every[1:][every[1:] == every[:-1]]]))
        lo, hi = (-(-(p << 16) // parts), -(-((p + 1) << 16) // parts))
        bits = np.zeros((hi - lo) << (size - 16), bool)
        for bit in filter_bits(shared, size):
            bits[bit - (lo << (size - 16))] = True
        raw, step = b"".join(group["sample"]), 6 + PIECE
        samples = {raw[i : i + 6]: raw[i + 6 : i + step] for i in range(0, len(raw), step)}
        good = [s for s, ok in zip(samples.values(), np.isin(unsix(b"".join(samples)), shared), strict=True) if ok]
        return pd.DataFrame({"lo": [lo], "bits": [np.packbits(bits).tobytes()], "sample": [b"".join(good[:64])]})

    settle(docs.sparkSession)
    rows = docs.select(key, text).mapInArrow(send, "part int, ones binary, many binary, sample binary").groupBy("part").applyInPandas(meet, "lo int, bits binary, sample binary")
    filter_, samples = np.zeros(1 << (size - 3), np.uint8), set()
    for row in rows.toLocalIterator():  # the filter's parts, 2^size bits in all, and 64 samples a part
        at = row.lo << (size - 19)
        filter_[at : at + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
        samples |= {bytes(row.sample[i : i + PIECE]) for i in range(0, len(row.sample), PIECE)}
    ordered = sorted(samples)
    return filter_, sorted({ordered[len(ordered) * i // parts] for i in range(1, parts)}) if ordered else []


def passing(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    left = np.arange(len(hashes))
    for bit in filter_bits(hashes, (8 * len(filter_)).bit_length() - 1):
        left = left[((filter_[bit[left] >> 3] >> (7 - (bit[left] & 7)).astype(np.uint8)) & 1).astype(bool)]
    return left


# --- sorted, front-coded runs ---------------------------------------------------------------------------


def prefixes(strings: list[bytes]) -> np.ndarray:
    """Length of the prefix that each string shares with the one before."""
    width = max(map(len, strings))
    grid = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width)
    differ = grid[1:] != grid[:-1]
    size = np.array([len(s) for s in strings])
    most = np.minimum(size[1:], size[:-1])
    return np.concatenate([[0], np.minimum(np.where(differ.any(1), differ.argmax(1), width), most)]).astype(np.uint8)


def pack(strings: list[bytes], fixed: np.ndarray) -> bytes:
    """A run: n, then shared prefix lengths, sizes of the rests, fixed-size records and the rests."""
    shared = prefixes(strings)
    rests = [s[k:] for s, k in zip(strings, shared.tolist(), strict=True)]
    return len(strings).to_bytes(4, "little") + shared.tobytes() + np.array([len(r) for r in rests], np.uint8).tobytes() + fixed.tobytes() + b"".join(rests)


RECORD = np.dtype([("content", "<u8"), ("doc", "<i8"), ("many", "u1"), ("before", "u1"), ("count", "u1")])


def unpack(run: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    n = int.from_bytes(run[:4], "little")
    shared, sizes = run[4 : 4 + n], run[4 + n : 4 + 2 * n]
    records = np.frombuffer(run, RECORD, n, 4 + 2 * n)
    at, last = 4 + 2 * n + n * RECORD.itemsize, b""
    for i in range(0, n, 256):  # all runs of a part are open at once, so few records of each are Python values
        for k, size, record in zip(shared[i : i + 256], sizes[i : i + 256], records[i : i + 256].tolist(), strict=True):
            last = last[:k] + run[at : at + size]
            at += size
            yield k, last, record


def merge(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """Merges sorted runs of (shared prefix, string, record) with a loser tree.

    Each head carries the prefix length it shares with the last string given out. Of two heads the one that
    shares more is smaller and nothing is compared; only heads that share equally much are compared, from
    that length on, and the loser then knows what it shares with the winner.
    """
    heads = [next(r, None) for r in runs]
    size = 1
    while size < len(runs):
        size *= 2
    heads += [None] * (size - len(heads))
    share = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        if heads[a] is None:
            return b, a
        if heads[b] is None:
            return a, b
        if share[a] != share[b]:
            return (a, b) if share[a] > share[b] else (b, a)
        k = share[a]
        x, y = heads[a][1], heads[b][1]
        if x == y:
            share[b] = len(y)
            return a, b
        s, t = x[k:], y[k:]
        n = min(len(s), len(t))
        d = int.from_bytes(s[:n]) ^ int.from_bytes(t[:n])
        k += n - (d.bit_length() + 7) // 8
        if s < t:
            share[b] = k
            return a, b
        share[a] = k
        return b, a

    tree = [0] * size
    level = list(range(size))
    at = size
    while len(level) > 1:
        at //= 2
        games = [play(level[i], level[i + 1]) for i in range(0, len(level), 2)]
        tree[at : at + len(games)] = [g[1] for g in games]
        level = [g[0] for g in games]
    top = level[0]
    while heads[top] is not None:
        _, string, record = heads[top]
        yield share[top], string, record
        following = next(runs[top], None)
        heads[top] = following
        if following is not None:
            share[top] = following[0]
        node = (top + size) >> 1
        while node:
            top, tree[node] = play(top, tree[node])
            node >>= 1


def strings_of(string: bytes, before: int, count: int, length: int) -> list[tuple[bytes, bytes]]:
    """The strings of a phrase: for each, its bytes from the anchor on and its bytes before the anchor backwards."""
    right, left = string[: len(string) - before], string[len(string) - before :]
    return [(right[: length - before + i], left[: before - i]) for i in range(count)]


def common(a: bytes, b: bytes) -> int:
    """Length of the prefix that two strings share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


def resolve(group: dict[tuple[bytes, int], list], commons: list[int], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(content, first string, last string, smaller document) for the strings of one anchor's phrases that documents share.

    group has each distinct phrase, in order, with its smallest document and whether there are others; commons are the
    prefixes that each shares with the one before. Of two phrases the bytes from the anchor on agree as far as the
    shortest common prefix between them goes, so only the bytes before the anchor are compared.
    """
    for content, doc, many, _, count in group.values():
        if many:
            yield content, 0, count - 1, doc
    if len(group) == 1:
        return
    rows = [(content, doc, before, count, len(string) - before, string[len(string) - before :]) for (string, before), (content, doc, _, _, count) in group.items()]
    if len(rows) > PAIRWISE:
        yield from crowd(rows, commons, length)
        return
    for k, (content, doc, before, count, _, left) in enumerate(rows):
        spans = []
        for step, others in ((-1, range(k - 1, -1, -1)), (1, range(k + 1, len(rows)))):
            shared = length << 8
            for q in others:
                shared = min(shared, commons[q + 1 if step < 0 else q])
                _, doc_q, _, _, right_q, left_q = rows[q]
                if doc_q < doc:
                    i, j = max(0, before - common(left, left_q)), min(count - 1, min(shared, right_q) - length + before)
                    if i <= j:
                        spans.append((i, j, doc_q))
        spans.sort()
        at = 0
        while at < len(spans):
            i, j, smaller = spans[at]
            at += 1
            while at < len(spans) and spans[at][0] <= j + 1:
                j = max(j, spans[at][1])
                at += 1
            yield content, i, j, smaller


def crowd(rows: list[tuple], commons: list[int], length: int) -> Iterator[tuple[int, int, int, int]]:
    """The same for many phrases: strings that reach equally far are equal if no common prefix between them is shorter
    and the bytes before the anchor, which are looked up, are the same. One reach is looked up after the other, so that
    what is held at once grows with the phrases, not with their strings."""
    steps = np.array(commons)
    best = np.repeat(np.array([doc for _, doc, *_ in rows], np.int64)[:, None], max(count for _, _, _, count, *_ in rows), 1)
    for reach in range(length - max(before for _, _, before, *_ in rows), length + 1):
        run = np.cumsum(steps < reach).tolist()  # the number of the run of phrases that share it
        least: dict[tuple[int, bytes], int] = {}
        own = []
        for k, (_, doc, before, count, _, left) in enumerate(rows):
            if 0 <= reach - length + before < count:
                s = (run[k], left[: length - reach])
                own.append((k, s))
                if least.get(s, doc) >= doc:
                    least[s] = doc
        for k, s in own:
            best[k, reach - length + rows[k][2]] = least[s]
    for (content, doc, _, count, *_), found in zip(rows, best, strict=True):
        own = found[:count].tolist()
        if min(own) == doc:
            continue
        start = 0
        for i in range(1, len(own) + 1):
            if i == len(own) or own[i] != own[start]:
                if own[start] < doc:
                    yield content, start, i - 1, own[start]
                start = i


def candidates(docs: DataFrame, key: str, text: str, length: int, shared) -> DataFrame:
    """(content, doc, first, strings) of each phrase whose anchor passes the filter."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            data, offsets = texts_of(batch.column(text))
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            for a, b in slices(offsets):
                own = offsets[a : b + 1] - offsets[a]
                doc, _, first, last, hashes, content = phrases(data[offsets[a] : offsets[b]], own, length)
                ok = passing(shared.value, hashes)
                doc, first, last = doc[ok], first[ok], last[ok]
                yield pa.RecordBatch.from_arrays([pa.array(content[ok].view(np.int64)), pa.array(keys[a:b][doc].astype(np.int64)), pa.array((first - own[doc]).astype(np.int32))], names=["content", "doc", "first"])

        return each

    return map_batches(docs.select(key, text), make, "content bigint, doc bigint, first int")


def smallest_documents(docs: DataFrame, key: str, text: str, length: int, shared, borders: list[bytes]) -> DataFrame:
    """(content, i, j, least): strings i to j of each phrase of that content start in document least first."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, int], list] = {}
        cuts = np.array(borders, dtype=f"S{PIECE}")

        def flush() -> Iterator[pa.RecordBatch]:
            order = sorted(held)
            strings = [s for s, _ in order]
            fixed = np.array([tuple(held[s]) for s in order], RECORD)
            part = np.searchsorted(cuts, np.array([s[:PIECE] for s in strings], dtype=f"S{PIECE}"), "right")
            cut = np.flatnonzero(np.diff(part, prepend=-1, append=part[-1] + 1))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([int(part[a])], pa.int32()), pa.array([pack(strings[a:b], fixed[a:b])], pa.binary())], names=["part", "run"])

        for batch in batches:
            data, offsets = texts_of(batch.column(text))
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            for a, b in slices(offsets):
                bytes_ = data[offsets[a] : offsets[b]]
                doc, anchor, first, last, hashes, content = phrases(bytes_, offsets[a : b + 1] - offsets[a], length)
                ok = passing(shared.value, hashes)
                whole = bytes_.tobytes()
                for k, at, lo, hi, c in zip(keys[a:b][doc[ok]].tolist(), anchor[ok].tolist(), first[ok].tolist(), last[ok].tolist(), content[ok].tolist(), strict=True):
                    string = whole[at : hi + length] + whole[lo:at][::-1]
                    known = held.get((string, at - lo))
                    if known is None:
                        held[string, at - lo] = [c, k, 0, at - lo, hi - lo + 1]
                    elif k != known[1]:
                        known[2] = 1
                        if k < known[1]:
                            known[1] = k
                if len(held) >= RUN_PHRASES:
                    yield from flush()
                    held.clear()
        if held:
            yield from flush()

    def found_in(runs: list[bytes]) -> Iterator[tuple[int, int, int, int, bytes | None]]:
        """The rows of a part, one after the other; strings that Spark has to bring together stand last in a row."""
        group, commons, too_many = {}, [], False

        def close(ends: bool) -> Iterator[tuple]:
            nonlocal group, commons, too_many
            if too_many or not ends:  # Spark brings equal strings together
                for (string, before), (content, doc, _, _, count) in group.items():
                    for i, (right, left) in enumerate(strings_of(string, before, count, length)):
                        yield content, i, i, doc, right + b"\0" + left
                too_many = not ends
            else:
                for row in resolve(group, commons, length):
                    yield *row, None
            group, commons = {}, []

        for k, string, record in merge([unpack(r) for r in runs]):
            if k < PIECE:
                yield from close(True)
            elif len(group) >= GROUP_PHRASES:
                yield from close(False)
            known = group.get((string, record[3]))
            if known is None:
                group[string, record[3]] = list(record)
                commons.append(k if group else 0)
            else:
                known[2] |= record[2] | (known[1] != record[1])
                known[1] = min(known[1], record[1])
        yield from close(True)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts follow one another; what is found leaves OUT_ROWS at a time, however much a part gives."""

        def told(runs: list[bytes]) -> Iterator[pa.RecordBatch]:
            rows = found_in(runs)
            while some := list(islice(rows, OUT_ROWS)):
                c, i, j, d, s = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(d, pa.int64()), pa.array(s, pa.binary())], names=["content", "i", "j", "least", "string"])

        part, runs = None, []
        for batch in batches:
            for p, run in zip(batch.column("part").to_pylist(), batch.column("run").to_pylist(), strict=True):
                if p != part:
                    yield from told(runs)
                    part, runs = p, []
                runs.append(run)
        yield from told(runs)

    runs = docs.select(key, text).mapInArrow(send, "part int, run binary").repartition("part").sortWithinPartitions("part")
    found = written(runs.mapInArrow(meet, "content bigint, i int, j int, least bigint, string binary"), "least")
    # Strings of anchors with very many phrases.
    open_ = found.where("string is not null")
    least = open_.groupBy("string").agg(F.min("least").alias("smallest"))
    late = open_.join(least, "string").select("content", "i", "j", F.col("smallest").alias("least")).distinct()
    return found.where("string is null").drop("string").union(late)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc, starts, ends): the maximal byte runs of each document that a smaller document repeats."""
    spark = docs.sparkSession
    docs = docs.where(F.col(key).isNotNull() & (F.octet_length(text) >= length))
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // PART_BYTES), 1 << 16)
    filter_, borders = shared_anchors(docs, key, text, length, parts, BITS if n_bytes < LARGE else LARGE_BITS)
    shared = spark.sparkContext.broadcast(filter_)
    least = smallest_documents(docs, key, text, length, shared, borders)
    found = candidates(docs, key, text, length, shared).join(least, "content").where("least < doc")
    found = found.select("doc", (F.col("first") + F.col("i")).alias("a"), (F.col("first") + F.col("j") + length).alias("b"))

    def make():
        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            spans = batch.column("spans")
            n = pc.list_value_length(spans).to_numpy(zero_copy_only=False)
            flat = spans.flatten()
            own = np.repeat(np.arange(len(n)), n) << 40  # each document's places in a range of their own
            a, b = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) + own for f in ("a", "b"))
            order = np.argsort(a, kind="stable")
            a, reach = a[order], np.maximum.accumulate(b[order])
            new = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
            starts, ends = a[new], reach[np.append(new[1:], len(a)) - 1]
            offsets = np.searchsorted(starts, np.arange(len(n) + 1) << 40).astype(np.int32)
            mask = (1 << 40) - 1
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x & mask)) for x in (starts, ends)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *lists], names=["doc", "starts", "ends"])

        return each

    gathered = found.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return map_batches(gathered, make, "doc bigint, starts array<bigint>, ends array<bigint>")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept (the bytes left) of each row of docs.

    Texts count as UTF-8 bytes. A byte is removed if a string of length bytes covers it that also starts in
    a row of a smaller key; strings are judged on the input. Null and empty texts have no bytes, texts
    shorter than length lose none. Keys are integers; rows with a null key lose nothing and cause no
    removal; rows of one key are never held against each other and each loses what the key's spans say, so
    keys should be unique. Other columns are not looked at, whatever their names. An empty table gives no rows. length
    is from 21 to 127; a text of any length is anchored piece by piece.
    """
    if not PIECE < length <= 127:
        raise ValueError(f"length has to be from {PIECE + 1} to 127 bytes: sizes within a phrase are kept in one byte")
    docs = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    key_field, key, text = T.StructField(key, docs.schema["__key"].dataType), "__key", "__text"
    spans = written(repeated_spans(docs, key, text, length), "spans")
    few = spans.agg(F.coalesce(F.sum(F.size("starts") + 4), F.lit(0))).first()[0] <= BROADCAST_ROWS
    joined = docs.select(key, text).join((F.broadcast(spans) if few else spans).withColumnRenamed("doc", "__doc"), F.col(key) == F.col("__doc"), "left").drop("__doc")

    def make():
        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            data, offsets = texts_of(batch.column(text))
            raw = memoryview(data)
            removed, counts, kept = [], [], []
            for i, (starts, ends) in enumerate(zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)):
                a, b = int(offsets[i]), int(offsets[i + 1])
                starts, ends = starts or [], ends or []
                kept.append(b"".join(raw[a + x : min(a + y, b)] for x, y in zip([0, *ends], [*starts, b - a], strict=True)))
                removed.append(b - a - len(kept[-1]))
                counts.append(len(starts))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())], names=[key_field.name, "n_bytes", "n_removed", "n_spans", "kept"])

        return each

    out = T.StructType([key_field, *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    return map_batches(joined, make, out)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = remove_repeats(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
