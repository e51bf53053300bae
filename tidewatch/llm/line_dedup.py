"""Line dedup: winnowing over line hashes.

A window is a shortest run of consecutive lines that holds least words, taken forwards from each line and
backwards from each line; equal runs have equal windows, and the windows inside a run of enough words cover
all of it. The line of the smallest hash of a window is its fingerprint: a guaranteed one, as equal windows
choose the same line. Only these minima are kept, each with its phrase, the lines that its windows reach.
Lines stand as 128-bit BLAKE2 digests of their bytes and phrases as digests of those, so that, unlike with a
polynomial hash, no text can be made whose lines count as others'.

Places of one fingerprint are joined. Places of equal phrases need no look: each but the first is a repeat.
The first places of different phrases are held against each other, and a match is extended line by line both
ways as far as both phrases go; where it has enough words, the later one's lines are a repeat. Fingerprints
with very many different phrases (a common line) have the windows of those phrases joined by content instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import by_group, fresh, join_hot, map_batches, slices, table, texts_of, written

WORDS = 50
PHRASES = 64  # phrases of a fingerprint that are held against each other
BROADCAST_BYTES = 32 << 20  # of deleted runs, at 24 bytes each
CHUNK = 1 << 22  # bytes of one text that are hashed at once
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
WIDE = 16  # bytes of a digest


def digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=WIDE).digest()


def lines_of(data: np.ndarray, offsets: np.ndarray, hashed: bool = True) -> tuple[np.ndarray, ...]:
    """text, start and end (bytes), digest (two numbers) and words of each line that is not blank; lines end at a line feed."""
    if len(offsets) == 2 and len(data) > CHUNK:  # one long text: piece by piece, cut at line feeds
        found, at = [], 0
        while at < len(data):
            rest = np.flatnonzero(data[at + CHUNK :] == 10)[:1]
            to = at + CHUNK + int(rest[0]) + 1 if len(rest) else len(data)
            text, start, end, line, words = _lines_of(data[at:to], np.array([0, to - at]), hashed)
            found.append((text, start + at, end + at, line, words))
            at = to
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    return _lines_of(data, offsets, hashed)


def _lines_of(data: np.ndarray, offsets: np.ndarray, hashed: bool) -> tuple[np.ndarray, ...]:
    n = len(data)
    cut = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], cut + 1]))
    start = start[start < n]
    end = np.concatenate([start[1:], [n]]) if len(start) else start
    end = end - (data[end - 1] == 10) if len(start) else end
    text = np.searchsorted(offsets, start, "right") - 1
    gap = _SPACE[data]
    begins = ~gap & np.concatenate([[True], gap[:-1]])
    begins[start[~gap[start]]] = True
    counted = np.concatenate([[0], np.cumsum(begins)])
    words = counted[end] - counted[start]
    full = words > 0
    text, start, end, words = text[full], start[full], end[full], words[full]
    raw = data.tobytes() if hashed else b""
    line = b"".join([digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]) if hashed else bytes(WIDE * len(start))
    return text, start, end, np.frombuffer(line, "<u8").reshape(-1, 2), words


def windows_of(text: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of each window."""
    n = len(text)
    total = np.concatenate([[0], np.cumsum(words)])
    bound = np.concatenate([np.flatnonzero(np.diff(text, prepend=-1)), [n]])
    own = np.searchsorted(bound, np.arange(n), "right") - 1
    last = np.searchsorted(total, total[:-1] + least) - 1  # forwards: total[last + 1] - total[i] >= least
    a = np.flatnonzero(last < bound[own + 1])
    first = np.searchsorted(total, total[1:] - least, "right") - 1  # backwards: total[i + 1] - total[first] >= least
    b = np.flatnonzero((total[1:] >= least) & (first >= bound[own]))
    pairs = np.unique(np.stack([np.concatenate([a, first[b]]), np.concatenate([last[a], b])], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def lowest(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The place of the smallest hash of each window, the first of equals."""
    n = len(hashes)
    levels, size = [np.arange(n)], 1
    while 2 * size <= int((last - first).max(initial=0)) + 1:  # smallest of 1, 2, 4 ... lines from each line on
        a, b = levels[-1][: n - 2 * size + 1], levels[-1][size : n - size + 1]
        levels.append(np.where(hashes[a] <= hashes[b], a, b))
        size *= 2
    level = np.log2(last - first + 1).astype(int)
    out = np.empty(len(first), np.int64)
    for k, places in enumerate(levels):
        own = np.flatnonzero(level == k)
        a, b = places[first[own]], places[last[own] - (1 << k) + 1]
        out[own] = np.where(hashes[a] <= hashes[b], a, b)
    return out


def text_mark(text: bytes) -> int:
    """Tells texts with one id apart."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


PLACE = "mark bigint, at int, fingerprint bigint, phrase binary, before int, lines binary, words binary"


def places_of(docs: DataFrame, least: int) -> DataFrame:
    """(id, mark, at, fingerprint, phrase, before, lines, words): the window minima of each text.

    at is the number of the line among those that are not blank. lines are the digests of the phrase's lines, before
    of them above the fingerprint, words their numbers of words; phrase is the digest of all of it.
    """

    def make():
        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            data, offsets = texts_of(batch.column("text"))
            ids = batch.column("id")
            for a, b in slices(offsets):
                at = offsets[a : b + 1] - offsets[a]
                part = data[offsets[a] : offsets[b]]
                doc, _, _, line, words = lines_of(part, at)
                if not len(line):
                    continue
                first, last = windows_of(doc, words, least)
                if not len(first):
                    continue
                chosen = lowest(line[:, 0], first, last)
                order = np.argsort(chosen, kind="stable")
                place, new = np.unique(chosen[order], return_index=True)
                lo, hi = np.minimum.reduceat(first[order], new), np.maximum.reduceat(last[order], new)
                start = np.searchsorted(doc, doc[place])
                raw, counts = line.tobytes(), words.astype("<u4").tobytes()
                before, lines = (place - lo).astype(np.int32), [raw[WIDE * x : WIDE * (y + 1)] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                phrase = [digest(x.to_bytes(4, "little") + y) for x, y in zip(before.tolist(), lines, strict=True)]
                full = np.unique(doc[place])
                marks = dict(zip(full.tolist(), (text_mark(part[at[i] : at[i + 1]].tobytes()) for i in full.tolist()), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a).take(pa.array(doc[place])), pa.array([marks[i] for i in doc[place].tolist()], pa.int64()), pa.array((place - start).astype(np.int32)), pa.array(line[place, 0].astype(np.uint64).view(np.int64)), pa.array(phrase, pa.binary()),
                        pa.array(before), pa.array(lines, pa.binary()), pa.array([counts[4 * x : 4 * y + 4] for x, y in zip(lo.tolist(), hi.tolist())], pa.binary()),
                    ],
                    names=["id", "mark", "at", "fingerprint", "phrase", "before", "lines", "words"],
                )

        return each

    return map_batches(docs, make, f"id {docs.schema['id'].dataType.simpleString()}, {PLACE}")


def extended(one: list[bytes], i: int, two: list[bytes], j: int) -> tuple[int, int]:
    """How many lines above and below the places i and j are equal, too."""
    up = 0
    while up < min(i, j) and one[i - up - 1] == two[j - up - 1]:
        up += 1
    down, room = 0, min(len(one) - i, len(two) - j) - 1
    while down < room and one[i + down + 1] == two[j + down + 1]:
        down += 1
    return up, down


def matches_of(group: dict[str, list], least: int, wide: int = 8) -> list[tuple]:
    """(place_id, place_mark, place_at, up, down): how far first places of a fingerprint's phrases, in their order, match earlier ones.

    wide is the number of bytes that stand for a line.
    """
    known, out = [], []
    for *place, before, lines, words in zip(*(group[c] for c in ("place_id", "place_mark", "place_at", "before", "lines", "words"))):
        own, found = [lines[x : x + wide] for x in range(0, len(lines), wide)], set()
        if known:
            total = [0, *np.cumsum(np.frombuffer(words, "<u4"), dtype=np.int64).tolist()]
            for other, k in known:
                up, down = extended(own, before, other, k)
                if total[before + down + 1] - total[before - up] >= least:
                    found.add((up, down))
        out += [(*place, u, d) for u, d in found if len(found) == 1 or not any((x >= u and y >= d) and (x, y) != (u, d) for x, y in found)]
        known.append((own, before))
    return out


def crowd_windows(classes: DataFrame, least: int) -> DataFrame:
    """(phrase's first place, content, up, down) of each window of each phrase; up and down may be negative."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            raw, counts = b"".join(batch.column("lines").to_pylist()), np.frombuffer(b"".join(batch.column("words").to_pylist()), "<u4")
            size = pa.compute.binary_length(batch.column("lines")).to_numpy() // WIDE
            own = np.repeat(np.arange(len(size)), size)
            first, last = windows_of(own, counts.astype(np.int64), least)
            at = own[first]
            content = [digest(raw[WIDE * x : WIDE * (y + 1)]) for x, y in zip(first.tolist(), last.tolist(), strict=True)]
            place = (np.cumsum(size) - size + batch.column("before").to_numpy())[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in ("place_id", "place_mark", "place_at")), pa.array(content, pa.binary()), pa.array((place - first).astype(np.int32)), pa.array((last - place).astype(np.int32))], names=["place_id", "place_mark", "place_at", "content", "up", "down"])

        return each

    kind = classes.schema["place_id"].dataType.simpleString()
    return map_batches(classes.select("place_id", "place_mark", "place_at", "before", "lines", "words"), make, f"place_id {kind}, place_mark bigint, place_at int, content binary, up int, down int")


def repeated_runs(docs: DataFrame, least: int) -> DataFrame:
    """(id, mark, first, last): runs of lines, by their numbers among those that are not blank, that an earlier place has, too."""
    places = written(places_of(docs.where("id is not null"), least), "places")
    place = F.struct("id", "mark", "at")
    every = places.groupBy("fingerprint", "phrase").agg(F.min(F.struct("id", "mark", "at", "before", "lines", "words")).alias("p"), F.count("*").alias("n"))
    classes = written(every.select("fingerprint", "phrase", F.col("p.id").alias("place_id"), F.col("p.mark").alias("place_mark"), F.col("p.at").alias("place_at"), (F.col("n") > 1).alias("again"), "p.before", "p.lines", "p.words"), "phrases")
    # Phrases that are there again: all places but the first.
    again = classes.where("again").select("phrase", F.struct(F.col("place_id").alias("id"), F.col("place_mark").alias("mark"), F.col("place_at").alias("at")).alias("first"), F.octet_length("lines").alias("size")).groupBy("phrase").agg(F.min("first").alias("first"), F.max("size").alias("size"))
    own = places.select("id", "mark", "at", "before", "phrase")
    copies = join_hot(own, again, "phrase").where(place > F.col("first"))
    runs = copies.select("id", "mark", (F.col("at") - F.col("before")).alias("first"), (F.col("at") - F.col("before") + F.col("size") / WIDE - 1).cast("int").alias("last"))
    # Different phrases around one fingerprint.
    shared = written(classes.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    near = join_hot(classes.drop("again"), shared, "fingerprint", shared)
    named = [F.col("place_id").alias("id"), F.col("place_mark").alias("mark"), (F.col("place_at") - F.col("up")).alias("first"), (F.col("place_at") + F.col("down")).alias("last")]
    some = near.where(F.col("n") <= PHRASES)
    kind = docs.schema["id"].dataType.simpleString()

    n_rows = shared.where(F.col("n") <= PHRASES).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    place_order = ["place_id", "place_mark", "place_at"]
    some = some.select("fingerprint", *place_order, "before", "lines", "words")
    matched = by_group(some, ["fingerprint"], place_order, n_rows, lambda g: matches_of(g, least, WIDE), f"place_id {kind}, place_mark bigint, place_at int, up int, down int")
    runs = runs.union(matched.select(*named))
    if shared.where(F.col("n") > PHRASES).limit(1).count():
        windows = written(crowd_windows(near.where(F.col("n") > PHRASES), least), "windows")
        start = F.struct(F.col("place_id").alias("id"), F.col("place_mark").alias("mark"), (F.col("place_at") - F.col("up")).alias("at"))
        source = windows.groupBy("content").agg(F.min(start).alias("source"), F.count("*").alias("n")).where("n > 1").select("content", "source")
        runs = runs.union(join_hot(windows, source, "content").where(start > F.col("source")).select(*named))
    return written(runs.distinct(), "runs")


def shortened(texts: pa.Array, own: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterable[tuple[bytes, int]]:
    """Each text without its runs of lines (own says whose they are), and how many lines those are; blank lines inside a run go, too."""
    data, offsets = texts_of(texts)
    order = np.lexsort((first, own))
    own, first, last = own[order], first[order], last[order]
    for a, b in slices(offsets):
        part, edge = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        text, start, end, _, _ = lines_of(part, edge, hashed=False)
        x, y = np.searchsorted(own, [a, b])
        base = np.searchsorted(text, own[x:y] - a)
        top, reach = start[base + first[x:y]], end[base + last[x:y]]
        feeds = np.concatenate([[0], np.cumsum(part == 10)])
        raw, at = part.tobytes(), 0
        spans = list(zip((own[x:y] - a).tolist(), top.tolist(), reach.tolist()))
        for k in range(b - a):
            kept, here, removed = [], int(edge[k]), 0
            stop = int(edge[k + 1])
            while at < len(spans) and spans[at][0] == k:
                _, lo, hi = spans[at]
                at += 1
                while at < len(spans) and spans[at][0] == k and spans[at][1] < hi:  # runs that overlap
                    hi = max(hi, spans[at][2])
                    at += 1
                kept.append(raw[here:lo])
                removed += int(feeds[hi] - feeds[lo]) + 1
                here = min(hi + 1, stop)
                if hi == stop and kept and (left := b"".join(kept)):  # the text's last line: the line feed before it goes, too
                    kept = [left[:-1]]
            yield b"".join([*kept, raw[here:stop]]), removed


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = WORDS) -> DataFrame:
    """docs with later repeats of line runs deleted from the text, and lines_removed, their number.

    A line goes if it lies in a run of consecutive lines, of least words in all, whose equal starts earlier:
    in a smaller key, or higher up in the same text. Lines are compared by 128-bit BLAKE2 digests of their bytes, blank lines are passed
    over (they go if they lie inside a deleted run), words are separated by ASCII white space. Runs may
    overlap their source. Other columns are kept, whatever their names, an own lines_removed is replaced. Null
    and empty texts stay as they are; rows with a null key are neither sources nor changed; rows that repeat both
    key and text are one document, and of different texts under one key the order is defined but arbitrary. An
    empty table gives no rows. A text of any length is hashed piece by piece.
    """
    runs = repeated_runs(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), least)
    docs = docs.drop("lines_removed")
    id_, gone = fresh(docs, "id", "gone")
    per_text = runs.groupBy(F.col("id").alias(id_)).agg(F.collect_list(F.struct("mark", "first", "last")).alias(gone))
    few = runs.count() * 24 <= BROADCAST_BYTES
    joined = docs.join(F.broadcast(per_text) if few else per_text, F.col(key) == F.col(id_), "left").drop(id_)
    fields = [*docs.schema.fields, T.StructField("lines_removed", T.IntegerType(), False)]

    def make():
        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            spans, texts, removed = batch.column(gone), batch.column(text), np.zeros(batch.num_rows, np.int32)
            at = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False) & texts.is_valid().to_numpy(zero_copy_only=False))
            if len(at):
                spans, old = spans.take(pa.array(at)), texts.take(pa.array(at))
                marks = np.array([text_mark(x.encode()) for x in old.to_pylist()], np.int64)
                own = np.repeat(np.arange(len(at)), pa.compute.list_value_length(spans).to_numpy())
                mark, first, last = (spans.flatten().field(c).to_numpy() for c in ("mark", "first", "last"))
                real = marks[own] == mark
                new, removed[at] = zip(*shortened(old, own[real], first[real].astype(np.int64), last[real].astype(np.int64)), strict=True)
                place = np.zeros(batch.num_rows, np.int64)
                place[at] = np.arange(len(at))
                chosen = np.zeros(batch.num_rows, bool)
                chosen[at] = removed[at] > 0
                texts = pa.compute.if_else(pa.array(chosen), pa.array(new, pa.binary()).cast(texts.type).take(pa.array(place)), texts)
            columns = [texts if f.name == text else batch.column(f.name) for f in docs_fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed)], names=[*(f.name for f in docs_fields), "lines_removed"])

        return each

    docs_fields = docs.schema.fields
    return map_batches(joined, make, T.StructType(fields))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "lines_removed", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
