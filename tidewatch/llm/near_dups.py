"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text gives the set of its distinct word shingles (64-bit mixes of BLAKE2 hashes of their words), a key of the whole set and a
   MinHash signature. Texts of equal sets become one node.
2. Signatures are cut into bands; nodes that share a band value are candidates. In each bucket every
   member is compared with the member that shares most bands with others (the likeliest original).
3. Comparing reads the signatures batch by batch and drops a pair once the posterior probability that its
   similarity reaches the threshold is below a chosen miss probability; only what is left has its full sets
   fetched and is verified on them.
4. Buckets whose members are still in different components are compared in blocks of signatures, across
   components only, and a few pairs for each two components are verified. Where more pass than that, the sets
   of the block are fetched and compared there, so that no link between different texts is lost and no
   bucket is listed pair by pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import BROADCAST_ROWS, by_group, connected, join_hot, map_batches, mix, slices, table, texts_of, written

SHINGLE, SLOTS, ROWS, BATCH = 5, 126, 6, 18
MISS = 1e-6
BLOCK, SIGNATURE_BLOCK = 256, 2048  # rows with sets, and with signatures alone, of a side that are compared at once
PAIRS = 4  # pairs of two components in a block that are verified one by one
CHUNK = 1 << 22  # bytes of one text that are hashed at once

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_TIMES, _PLUS = (_rng.integers(0, 1 << 63, SLOTS, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_WORD_AT = _rng.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the number of words of each text; ASCII letters are lowered, ASCII white space separates."""
    if len(offsets) == 2 and len(data) > CHUNK:  # one long text: piece by piece, cut at white space
        found, at = [], 0
        while at < len(data):
            rest = np.flatnonzero(_SPACE[data[at + CHUNK : at + 2 * CHUNK]])
            to = at + CHUNK + int(rest[0]) if len(rest) else len(data)
            found.append(_word_hashes(data[at:to], np.array([0, min(to, len(data)) - at]))[0])
            at = to
        return np.concatenate(found), np.array([sum(map(len, found))])
    return _word_hashes(data, offsets)


class Words(dict):
    """Word -> its BLAKE2 hash of 64 bits; remembered up to a number of characters."""

    def __init__(self, most: int = 1_500_000) -> None:
        super().__init__()
        self.most, self.held = most, 0

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self.held += len(word)
            if self.held > self.most:
                self.clear()
                self.held = len(word)
            self[word] = value
        return value


WORDS = Words()


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw, edges = data.tobytes().lower(), offsets.tolist()  # bytes: A-Z only, and split() at ASCII white space
    words = [raw[a:b].split() for a, b in zip(edges, edges[1:], strict=False)]
    counts = np.array([len(w) for w in words], np.int64)
    return np.fromiter(map(WORDS.__getitem__, chain.from_iterable(words)), np.uint64, int(counts.sum())), counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; fewer words than width are one shingle, none are no shingle."""
    words, counts = word_hashes(data, offsets)
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for i in range(min(width, n)):
        rolled[: n - i] += words[i:] * _WORD_AT[i]
    rolled = mix(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(rolled[at : at + c - width + 1]))
        elif c:
            out.append(mix((words[at : at + c] * _WORD_AT[:c]).sum(dtype=np.uint64)[None] + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures of non-empty sets, one row each."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), SLOTS), np.uint32)
    for k in range(SLOTS):
        out[:, k] = np.minimum.reduceat((flat * _TIMES[k] + _PLUS[k]) >> np.uint64(32), starts)
    return out


def shingled(docs: DataFrame, carried: list[str], with_set: bool) -> DataFrame:
    """(carried columns, n_shingles, set_key, sig) of each row's text, or (carried columns, sig, shingles) of rows that have shingles."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            data, offsets = texts_of(batch.column("text"))
            own = [batch.column(c) for c in carried]
            for a, b in slices(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                full = [i for i, s in enumerate(sets) if len(s)]
                sigs = signatures([sets[i] for i in full]) if full else []
                sig = dict(zip(full, (s.tobytes() for s in sigs), strict=True))
                if with_set:
                    at = pa.array(full, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a).take(at) for c in own), pa.array([sig[i] for i in full], pa.binary()), pa.array([sets[i].tobytes() for i in full], pa.binary())], names=[*carried, "sig", "shingles"])
                else:
                    keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                    yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in own), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([sig.get(i) for i in range(len(sets))], pa.binary())], names=[*carried, "n_shingles", "set_key", "sig"])

        return each

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried)
    return map_batches(docs.select(*carried, "text"), make, f"{kinds}, sig binary, shingles binary" if with_set else f"{kinds}, n_shingles bigint, set_key binary, sig binary")


def least_matches(percent: int, miss: float) -> list[int]:
    """For each batch read, the matches below which P(similarity >= threshold | matches) < miss, with a uniform prior.

    The posterior after m of k matches is Beta(m + 1, k - m + 1), whose tail is a binomial sum.
    """
    t, out = percent / 100, []
    for k in range(BATCH, SLOTS + 1, BATCH):
        total = 0.0
        for m in range(k + 1):
            total += math.comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
            if total >= miss:
                break
        out.append(m)
    return out


def passes(one: np.ndarray, many: np.ndarray, least: list[int]) -> np.ndarray:
    """Indices of the rows of many that the batches of one's signature do not rule out."""
    left, matches = np.arange(len(many)), np.zeros(len(many), np.int32)
    for step, m in enumerate(least):
        part = slice(step * BATCH, (step + 1) * BATCH)
        matches = matches + (many[left, part] == one[part]).sum(1)
        stay = matches >= m
        left, matches = left[stay], matches[stay]
        if not len(left):
            break
    return left


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def survivors(pairs: DataFrame, least: list[int]) -> DataFrame:
    """The pairs (a, b, sig_a, sig_b) that their signatures do not rule out, without the signatures."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SLOTS) for c in ("sig_a", "sig_b"))
            left, matches = np.arange(len(one)), np.zeros(len(one), np.int32)
            for step, m in enumerate(least):
                part = slice(step * BATCH, (step + 1) * BATCH)
                matches = matches + (one[left, part] == two[left, part]).sum(1)
                stay = matches >= m
                left, matches = left[stay], matches[stay]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(left)) for c in ("a", "b")], names=["a", "b"])

        return each

    kind = pairs.schema["a"].dataType.simpleString()
    return map_batches(pairs.select("a", "b", "sig_a", "sig_b"), make, f"a {kind}, b {kind}")


def with_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (id and other columns, a written table) with the signature and the set of each id."""
    few = wanted.limit(BROADCAST_ROWS // 4 + 1).count() <= BROADCAST_ROWS // 4
    return shingled(docs.join(F.broadcast(wanted) if few else wanted, "id"), wanted.columns, True)


def verified(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, a written table) that are similar by their sets. Pairs of one a are compared in groups of BLOCK."""
    counts = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts")), "counts")
    large = counts.where("salts > 1")
    if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        large = F.broadcast(large)
    members = pairs.join(large, "a", "left").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), F.lit(1).alias("side"))
    heads = counts.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"))
    wanted = written(members.union(heads), "wanted")
    sets = with_sets(docs, wanted)

    def compare(group: dict[str, list]) -> list[tuple]:
        heads = [np.frombuffer(s, np.uint64) for side, s in zip(group["side"], group["shingles"]) if not side]
        return [(a, b) for a, b, side, s in zip(group["a"], group["id"], group["side"], group["shingles"]) if side and any(similar(h, np.frombuffer(s, np.uint64), percent) for h in heads)]

    kind = pairs.schema["a"].dataType.simpleString()
    return by_group(sets.drop("sig"), ["a", "salt"], [], wanted.count(), compare, f"a {kind}, b {kind}", 2000).distinct()


def sides_of(group: dict[str, list]) -> tuple[np.ndarray, ...]:
    """ids, labels, signatures and the places of either side; without a side 1, side 0 stands against itself."""
    sigs = np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(len(group["sig"]), SLOTS)
    side = np.array(group["side"])
    return np.array(group["id"], object), np.array(group["label"], object), sigs, np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def likely_pairs(group: dict[str, list], least: list[int], most: int = PAIRS) -> list[tuple]:
    """most pairs at most for each two labels that their signatures do not rule out; a last (None, None) says that there are more."""
    ids, labels, sigs, ones, others = sides_of(group)
    _, number = np.unique(labels, return_inverse=True)
    taken: dict[tuple, int] = {}
    done: dict[int, set[int]] = {}  # labels that a label has pairs enough with
    found, more = [], False
    for at, i in enumerate(ones):
        pool = others if len(others) else ones[at + 1 :]
        mine = int(number[i])
        pool = pool[number[pool] != mine]
        if mine in done:
            pool = pool[~np.isin(number[pool], list(done[mine]))]
        for j in pool[passes(sigs[i], sigs[pool], least)] if len(pool) else ():
            yours = int(number[j])
            pair = (min(mine, yours), max(mine, yours))
            taken[pair] = n = taken.get(pair, 0) + 1
            if n <= most:
                found.append((ids[i], ids[j]))
            else:
                more = True
                done.setdefault(mine, set()).add(yours)
                done.setdefault(yours, set()).add(mine)
    return [*found, (None, None)] if more else found


def links_of(group: dict[str, list], percent: int, least: list[int]) -> list[tuple]:
    """Links between rows of either side that have different labels, by their sets.

    Once two labels are linked, more pairs of them are not looked at: only components are asked for.
    """
    ids, labels, sigs, ones, others = sides_of(group)
    sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
    root = {x: x for x in labels.tolist()}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = []
    for at, i in enumerate(ones):
        pool = others if len(others) else ones[at + 1 :]
        if not len(pool):
            continue
        mine = find(labels[i])
        pool = pool[np.fromiter((find(x) != mine for x in labels[pool].tolist()), bool, len(pool))]
        for j in pool[passes(sigs[i], sigs[pool], least)]:
            mine, yours = find(labels[i]), find(labels[j])
            if mine != yours and similar(sets[i], sets[j], percent):
                root[yours] = mine
                found.append((ids[i], ids[j]))
    return found


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, component) after more links (a, b): components are connected by their labels, not link by link."""
    if not links.limit(1).count():
        return labels
    of = lambda c, name: labels.select(F.col("id").alias(c), F.col("component").alias(name))
    named = written(links.join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), "links")
    merged = connected(named.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    new = named.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("ca").alias("component")), F.struct(F.col("b").alias("id"), F.col("cb").alias("component")))).alias("n")).select("n.*")
    every = labels.union(new).distinct()
    return written(every.join(merged.select(F.col("id").alias("component"), F.col("component").alias("least")), "component", "left").select("id", F.coalesce("least", "component").alias("component")), "labels")


def blocks_of(rows: DataFrame, size: int) -> DataFrame:
    """Rows (band, id, label) of bands with several labels, dealt into pairs of blocks (band, i, j) of about size rows a side."""
    split = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark")).where("lo <> hi")
    # Bands that hold the same members are compared once.
    split = written(split.groupBy("mark", "n").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / size).cast("int").alias("blocks"), "n"), "open")
    dealt = join_hot(rows, split.drop("n"), "band", split).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("band", "id", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, miss: float = MISS) -> DataFrame:
    """key, n_shingles, component_id and kept of every row of docs.

    Rows are linked where 100 * shared shingles >= percent * united shingles; component_id is the smallest
    key reachable over links, kept says that it is the row's own. A null or empty text, or one of white
    space, has no shingles and is linked with nothing; a text of fewer than five words is one shingle.
    All rows are returned, repeated ones too. Keys should be unique: different texts whose smallest key is
    the same count as linked. Rows with a null key are unlinked, with a null component and kept true. Other
    columns are not looked at, whatever their names. An empty table gives no rows. The bands meet a pair of
    similarity 0.85 with a probability of 99.995 %, one of 0.80 with 99.8 %; a text of any length is hashed
    piece by piece.
    """
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    nodes = written(shingled(docs, ["id"], False), "shingled")
    named = nodes.where("set_key is not null and id is not null")
    same = written(named.groupBy("set_key").agg(F.min("id").alias("node"), F.max("sig").alias("sig")), "sets")
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(SLOTS // ROWS)])
    rows = same.select(F.col("node").alias("id"), F.explode(bands).alias("band"))
    shared = written(rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    live = written(join_hot(rows, shared, "band", shared), "bands")
    degree = live.groupBy("id").agg(F.sum("n").alias("degree"))
    pivot = live.join(degree, "id").groupBy("band").agg(F.max(F.struct("degree", F.negative("id").alias("id"))).alias("top")).select("band", F.negative("top.id").alias("a"))
    stars = written(join_hot(live, pivot, "band", shared).where("id <> a").select("a", F.col("id").alias("b")).distinct(), "stars")

    least = least_matches(percent, miss)
    sigs = lambda c: same.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))
    likely = written(survivors(join_hot(stars, sigs("a"), "a").join(sigs("b"), "b"), least), "likely")
    first = written(verified(docs, likely, percent), "links")
    labels = written(connected(first), "labels")

    def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")

    open_ = written(blocks_of(written(labelled(live.select("band", "id"), labels), "labelled"), SIGNATURE_BLOCK), "blocks")
    block, shape = ["band", "i", "j"], f"band bigint, i int, j int, a {kind}, b {kind}"
    likely_of = lambda g: [(*(g[c][0] for c in block), *p) for p in likely_pairs(g, least, PAIRS)]
    looked = open_.join(same.select(F.col("node").alias("id"), "sig"), "id")
    looked = written(by_group(looked, block, [], open_.count(), likely_of, shape, 2 * SIGNATURE_BLOCK), "looked")
    second = written(verified(docs, written(looked.where("a is not null").select("a", "b").distinct(), "likely"), percent), "links")
    labels = joined(labels, second)

    crowds = looked.where("a is null").select(*block)
    if crowds.limit(1).count():
        # The members of blocks where too many pairs pass, dealt anew with their sets, if they still have several labels.
        members = written(open_.join(crowds, block, "left_semi").select(F.xxhash64(*block).alias("band"), "id").distinct(), "members")
        again = written(blocks_of(written(labelled(members, labels), "labelled"), BLOCK), "blocks")
        third = by_group(with_sets(docs, again), block, [], again.count(), lambda g: links_of(g, percent, least), f"a {kind}, b {kind}", 2 * BLOCK)
        labels = joined(labels, written(third, "links"))

    found = same.select("set_key", "node").join(labels.withColumnRenamed("id", "node"), "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    out = nodes.select("id", "n_shingles", "set_key").join(found, "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op3_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
