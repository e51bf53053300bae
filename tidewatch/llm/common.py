"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

TOKENIZER_DIR = "/opt/tokenizers"

#: Rows that a side may have to be broadcast (one long key each); beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """The place of a public tokenizer file; folder overrides the installed package."""
    if folder:
        return f"{folder}/{name}"
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"{TOKENIZER_DIR}/{name}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one is made only on a local master (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: steps have to be written where all machines can read them")
        conf = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


#: Session settings that the operators rely on. Few rows go to Python at once, as texts are long. A union is not
#: taken as partitioned like its parts: in Spark 4.1.2 a later join or window then loses rows.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.unionOutputPartitioning": "false"}


def settle(spark: SparkSession) -> None:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, gives the planner true sizes."""
    spark = df.sparkSession
    settle(spark)
    path = f"{shared_dir(spark)}/tidewatch-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_keys(df: DataFrame, keys: DataFrame, key: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose key is among the distinct keys; broadcast only under a counted bound, else a shuffled join."""
    keys = keys.select(key)
    if keys.limit(most + 1).count() <= most:
        keys = F.broadcast(keys)
    return df.join(keys, key, "left_semi")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that df has no column of."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_hot(left: DataFrame, right: DataFrame, key: str, counts: DataFrame | None = None, hot: int = 2_000) -> DataFrame:
    """Inner join with right, which has one row a key at most, so that no key gathers in one task.

    Keys with more than hot rows of left, and more than a 500th of them (fewer than 500 keys by that), are joined
    by broadcast, where their rows lie; the others are shuffled. left is read twice, so it should be a written
    table; counts, if it is known already, has the rows n of each key of left that matters.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    n = left.count()
    heavy = [r[0] for r in counts.where(F.col("n") > max(hot, n // 500)).select(key).collect()] if n > hot else []
    if not heavy:
        return left.join(right, key)
    few = lambda df: df.where(F.col(key).isin(heavy))
    rest = lambda df: df.where(~F.col(key).isin(heavy))
    return rest(left).join(rest(right), key).unionByName(few(left).join(F.broadcast(few(right)), key))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about most bytes each, so that arrays made for a range stay small; one row at least."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = 1 << (n - 1).bit_length()
            self.up = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(m - 1, BASE))])
            self.down = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(m - 1, UNBASE))])
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P, D): the hash of data[a:b] is mix((P[b] - P[a]) * D[a]) for any a < b, all modulo 2^64."""
    up, down = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], out=out[1:])
    return out, down


def span_hash(prefix: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with state that is made once a task: make() gives the function for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            yield from each(batch)

    settle(df.sparkSession)
    return df.mapInArrow(run, schema)


def by_group(df: DataFrame, keys: list[str], order: list[str], rows: int, each: Callable[[dict[str, list]], list[tuple]], schema: T.StructType | str, per_task: int = 20_000) -> DataFrame:
    """each() of every group of rows with equal keys, given as columns of values in that order, as one table.

    For many small groups of bounded size: rows (their number is known) are dealt to tasks by the keys and sorted, and
    groups follow one another in a stream without a frame of their own.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))
    shape = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(shape)

    def groups(table: pa.Table, ends: list[int]) -> Iterable[pa.RecordBatch]:
        columns = {name: table.column(name).to_pylist() for name in table.column_names}
        out, a = [], 0
        for b in ends:
            out += each({n: c[a:b] for n, c in columns.items()})
            a = b
        for i in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 10_000], strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            differ = np.zeros(max(0, len(table) - 1), bool)
            for k in keys:
                column = table.column(k).combine_chunks()
                differ |= pa.compute.not_equal(column.slice(1), column.slice(0, max(0, len(column) - 1))).to_numpy(zero_copy_only=False)
            ends = (np.flatnonzero(differ) + 1).tolist()
            if ends:
                yield from groups(table.slice(0, ends[-1]), ends)
            rest = table.slice(ends[-1] if ends else 0)
        if rest is not None and len(rest):
            yield from groups(rest, [len(rest)])

    settle(spark)
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, shape)


def with_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], rows: int = 512) -> DataFrame:
    """df with computed columns after its own, made for some rows at a time; an own column of the same name is replaced."""
    names = {f.name for f in fields}
    source = df
    kept = [f for f in df.schema.fields if f.name not in names]

    def make_each():
        each = make()

        def run(whole: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            for i in range(0, whole.num_rows, rows):
                batch = whole.slice(i, rows)
                made = each(batch)
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *made], names=[*(f.name for f in kept), *(f.name for f in fields)])

        return run

    return map_batches(source, make_each, T.StructType([*kept, *fields]))


def connected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component), component the smallest id reachable.

    Alternates large-star and small-star steps, which keep as many edges at most as there were and need
    about log(n) rounds; every round is a written table. Only nodes that have an edge are returned.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = join_hot(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_hot(large, least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id").union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
