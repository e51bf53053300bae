"""Near-duplicate vectors by product quantisation over coarse inverted lists.

Coarse centroids and residual sub-codebooks are fitted on a bounded sample, one index for each vector length;
every vector is indexed. Lists hold codes only. A vector goes as a query to its own list and to each list of a
higher number that a vector within reach could have been put into, so that a pair is met once, whichever side
it is seen from. There a table look-up for each subspace gives asymmetric distances, and what they cannot rule
out is ranked by the exact cosine in double precision, with vectors fetched for those pairs alone; blocks where
the look-up passes very many pairs (crowds of copies) get their vectors and are compared in place. The look-up
loses nothing: a stored vector's own coding error is added to the bound. Only the choice of lists can miss a
link, at a rate set by certainty.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import BROADCAST_ROWS, connected, join_hot, settle, table, written

SAMPLE_ROWS, SUBSPACES, CODES, ROUNDS = 8192, 8, 256, 6
CERTAINTY = 3.0
MOST_LISTS, SAMPLE_A_LIST = 16_384, 8  # lists grow with the root of the vectors; the sample follows, 131,072 rows at most
BLOCK_STORED, BLOCK_QUERIES = 4096, 4096
SPARSE = 4  # pairs a row of a block up to which they are fetched one by one


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        order = np.argsort(own, kind="stable")
        full, at = np.unique(own[order], return_index=True)
        c[full] = np.add.reduceat(x[order], at, axis=0) / np.diff(np.append(at, len(x)))[:, None]
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])


@dataclass
class Index:
    centroids: np.ndarray
    books: list[np.ndarray]  # one codebook of residuals for each subspace
    cuts: list[int]
    reach: float  # greatest distance of unit vectors that are to be linked
    certainty: float
    spread: float  # dimensions that the sample spreads over, by the participation ratio of its variances

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance of each vector from what its codes stand for."""
        rest = x - self.centroids[own]
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], 1).astype(np.uint8)
        back = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], 1)
        return codes, np.sqrt(((rest - back) ** 2).sum(1))

    def probes(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which lists each vector has to look at, of its own number or above.

        A vector at a distance of reach in a random direction moves the difference of the squared distances
        to two centroids by a normal variable; certainty is the number of its deviations that are allowed for.
        """
        d = squared(x, self.centroids)
        lists, at = np.unique(own, return_inverse=True)  # distances between lists that vectors are in, not between all
        apart = np.sqrt(squared(self.centroids[lists], self.centroids))[at]
        near = d - d[np.arange(len(x)), own][:, None] <= 2 * self.certainty * self.reach * apart / np.sqrt(self.spread) + 1e-12
        return near & (np.arange(len(self.centroids)) >= own[:, None])

    def distances(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of queries (exact) from stored vectors (coded), by table look-up."""
        rest = q - self.centroids[cell]
        out = np.zeros((len(q), len(codes)), np.float32)
        for m, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            out += squared(rest[:, a:b], book).astype(np.float32)[:, codes[:, m]]
        return out


def fit(x: np.ndarray, lists: int, cosine: float, certainty: float, seed: int = 5) -> Index:
    rng = np.random.default_rng(seed)
    c = kmeans(x, lists, rng)
    rest = x - c[nearest(x, c)]
    cuts = sorted({round(i * x.shape[1] / SUBSPACES) for i in range(SUBSPACES + 1)})
    books = [kmeans(rest[:, a:b], CODES, rng) for a, b in zip(cuts, cuts[1:])]
    variances = np.maximum(np.linalg.eigvalsh(np.cov(x, rowvar=False).reshape(x.shape[1], -1)), 0) if len(x) > 1 else np.zeros(1)
    spread = float(variances.sum() ** 2 / (variances**2).sum()) if variances.any() else 1.0
    return Index(c, books, cuts, float(np.sqrt(max(0.0, 2 - 2 * cosine))), certainty, min(spread, x.shape[1]))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def grid(rows, kind: str) -> np.ndarray:
    """Unit vectors from their raw bytes."""
    raw = b"".join(rows)
    return unit(np.frombuffer(raw, kind).reshape(len(rows), -1)) if len(rows) else np.zeros((0, 1))


def passing(index: Index, cell: int, q: np.ndarray, codes: np.ndarray, errors: np.ndarray, q_ids: np.ndarray, x_ids: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, stored) that the look-up cannot rule out, some queries at a time; of the list's own vectors each pair once."""
    bound = ((index.reach + errors) ** 2 * 1.0001 + 1e-5).astype(np.float32)
    for a in range(0, len(q), 512):
        i, j = np.nonzero(index.distances(q[a : a + 512], cell, codes) <= bound)
        i += a
        once = ~own[i] | (q_ids[i] < x_ids[j])
        yield i[once], j[once]


def is_near(u: np.ndarray, v: np.ndarray, cosine: float) -> np.ndarray:
    return np.einsum("ij,ij->i", u, v) >= cosine


def links_in(pairs: Iterator[tuple[np.ndarray, np.ndarray]], q_ids, q, q_copies, x_ids, x, x_copies, cosine: float) -> list[tuple]:
    """Rows (id, n, other): the copies that a vector is linked with, and links enough to join what is linked here."""
    n_q, n_x, out, root = np.zeros(len(q), np.int64), np.zeros(len(x), np.int64), [], {}

    def find(v):
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for i, j in pairs:
        good = np.concatenate([is_near(q[i[k : k + 65536]], x[j[k : k + 65536]], cosine) for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
        i, j = i[good], j[good]
        np.add.at(n_q, i, x_copies[j])
        np.add.at(n_x, j, q_copies[i])
        for u, v in zip(q_ids[i].tolist(), x_ids[j].tolist()):
            s, t = find(u), find(v)
            if s != t:
                root[max(s, t)] = min(s, t)
                out.append((u, 0, v))
    for ids, n in ((q_ids, n_q), (x_ids, n_x)):
        out += [(int(ids[k]), int(n[k]), None) for k in np.flatnonzero(n)]
    return out


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, certainty: float = CERTAINTY, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """key, n_links, component_id and kept of every row.

    Rows are linked where the cosine of their vectors, in double precision, is cosine at least; vectors of
    different lengths never are. n_links counts the other rows linked directly, component_id is the smallest key
    reachable. A vector that is null or empty, holds a null or a number that is not finite, or is zero, links with
    nothing; so does a row without a key, whose component is null. Equal vectors are indexed once and count as
    often as they are there. Keys should be unique integers. Other columns are not looked at. An empty table gives
    no rows.
    """
    spark = vectors.sparkSession
    settle(spark)
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"
    kind, number = ("float32", "float") if single else ("float64", "double")
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast(f"array<{number}>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(F.col("id").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(usable, F.col("v")))
    nodes = written(rows.where("v is not null").groupBy("v").agg(F.min("id").cast("long").alias("node"), F.count("*").alias("copies")), "vectors")
    indexes: dict[int, Index] = {}
    for d, n in nodes.groupBy(F.size("v")).count().where("count > 1").collect():  # one row a vector length
        lists = int(min(MOST_LISTS, max(1, np.sqrt(n) / 2)))
        most = max(sample_rows, SAMPLE_A_LIST * lists)
        share = min(1.0, 2 * (most + 100) / n)
        sample = nodes.where(F.size("v") == d).withColumn("h", F.xxhash64("node")).where(F.col("h") / 2.0**63 <= 2 * share - 1).orderBy("h").limit(most).select("v").toPandas()
        indexes[d] = fit(unit(np.stack(sample["v"])), lists, cosine, certainty)
    shared = spark.sparkContext.broadcast(indexes)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for d, same in whole.groupby(whole["v"].map(len)):
                index = shared.value.get(d)
                for a in range(0, len(same) if index else 0, 1024):
                    f = same.iloc[a : a + 1024]
                    raw = np.stack(f["v"]).astype(kind)
                    x = unit(raw)
                    own = nearest(x, index.centroids)
                    codes, errors = index.encode(x, own)
                    ids, copies = f["node"].to_numpy(), f["copies"].to_numpy()
                    yield pd.DataFrame({"d": d, "cell": own, "side": 1, "own": False, "id": ids, "copies": copies, "vec": None, "codes": [c.tobytes() for c in codes], "error": errors})
                    i, cell = np.nonzero(index.probes(x, own))
                    blobs = np.array([v.tobytes() for v in raw], object)
                    yield pd.DataFrame({"d": d, "cell": cell, "side": 0, "own": cell == own[i], "id": ids[i], "copies": copies[i], "vec": blobs[i], "codes": None, "error": 0.0})

    entries = nodes.mapInPandas(assign, "d int, cell int, side int, own boolean, id bigint, copies bigint, vec binary, codes binary, error double")
    entries = written(entries, "lists")
    cells = ["d", "cell"]
    # One row a list: how many blocks its two sides are dealt into.
    blocks = entries.groupBy(*cells).agg(F.ceil(F.count_if(F.col("side") == 1) / BLOCK_STORED).cast("int").alias("xs"), F.ceil(F.count_if(F.col("side") == 0) / BLOCK_QUERIES).cast("int").alias("qs")).where("xs > 0 and qs > 0")
    dealt = entries.join(F.broadcast(blocks), cells).withColumn("h", F.xxhash64("id"))  # MOST_LISTS rows a length at most
    stored = F.col("side") == 1
    dealt = dealt.withColumn("xb", F.explode(F.when(stored, F.array(F.pmod("h", "xs").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("xs") - 1))))
    dealt = dealt.withColumn("qb", F.explode(F.when(stored, F.sequence(F.lit(0), F.col("qs") - 1)).otherwise(F.array(F.pmod("h", "qs").cast("int"))))).drop("h", "xs", "qs")
    block = [*cells, "xb", "qb"]

    def sides(group: pd.DataFrame):
        index = shared.value[int(group["d"].iloc[0])]
        q, x = group[group["side"] == 0], group[group["side"] == 1]
        codes = np.frombuffer(b"".join(x["codes"]), np.uint8).reshape(-1, len(index.books))
        vectors_ = grid(q["vec"], kind)
        pairs = passing(index, int(group["cell"].iloc[0]), vectors_, codes, x["error"].to_numpy(), q["id"].to_numpy(), x["id"].to_numpy(), q["own"].to_numpy(bool))
        return q, x, vectors_, pairs

    def look_up(group: pd.DataFrame) -> pd.DataFrame:
        """Pairs to be ranked, or the block with null ids if they are too many to be fetched one by one."""
        q, x, _, pairs = sides(group)
        held, n = [], 0
        for i, j in pairs:
            held.append((q["id"].to_numpy()[i], x["id"].to_numpy()[j]))
            n += len(i)
            if n > SPARSE * (len(q) + len(x)):
                return group[block].head(1).assign(a=pd.array([None], "Int64"), b=pd.array([None], "Int64"))
        a, b = (np.concatenate(c) for c in zip(*held)) if held else (np.zeros(0, np.int64),) * 2
        return pd.DataFrame({**{c: group[c].iloc[0] for c in block}, "a": a, "b": b}, index=range(len(a)))

    looked = written(dealt.groupBy(*block).applyInPandas(look_up, "d int, cell int, xb int, qb int, a bigint, b bigint"), "pairs")

    def rank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for _, f in whole.groupby(whole["u"].map(len)):
                good = f[is_near(grid(f["u"].map(lambda v: np.asarray(v, kind).tobytes()), kind), grid(f["v"].map(lambda v: np.asarray(v, kind).tobytes()), kind), cosine)]
                yield pd.DataFrame({"id": good["a"], "n": good["n_b"], "other": good["b"]})
                yield pd.DataFrame({"id": good["b"], "n": good["n_a"], "other": None}).astype({"other": "Int64"})

    side = lambda id_, v, n: nodes.select(F.col("node").alias(id_), F.col("v").alias(v), F.col("copies").alias(n))
    pairs = looked.where("a is not null").select("a", "b")
    pairs = join_hot(written(join_hot(pairs, side("a", "u", "n_a"), "a"), "pairs"), side("b", "v", "n_b"), "b")
    shape = "id bigint, n bigint, other bigint"
    found = pairs.mapInPandas(rank, shape)

    crowds = looked.where("a is null").select(*block)
    if crowds.limit(1).count():
        few = crowds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        crowded = dealt.join(F.broadcast(crowds) if few else crowds, block, "left_semi")
        crowded = crowded.join(nodes.select(F.col("node").alias("id"), F.col("v").alias("whole")), "id")

        def compare(group: pd.DataFrame) -> pd.DataFrame:
            q, x, vectors_, pairs = sides(group)
            own = unit(np.stack(x["whole"]).astype(kind))
            out = links_in(pairs, q["id"].to_numpy(), vectors_, q["copies"].to_numpy(), x["id"].to_numpy(), own, x["copies"].to_numpy(), cosine)
            return pd.DataFrame(out, columns=["id", "n", "other"]).astype({"id": "int64", "n": "int64", "other": "Int64"})

        found = found.union(crowded.groupBy(*block).applyInPandas(compare, shape))
    found = written(found, "found")
    components = connected(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "node")
    known = nodes.join(counts, "node", "left").join(components.withColumnRenamed("id", "node"), "node", "left")
    known = known.select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("c"))
    out = rows.join(known, "v", "left")
    component = F.coalesce("c", "id").cast("long")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op7_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
