"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A fixed mask reads some of the tokens in a span and ignores the others. The default mask reads the places
0, 1, 3, 6 and 7; in any 13 tokens of which two at most differ, it fits somewhere without touching a
difference, so no such overlap is missed. Masked hashes of the documents are joined with those of the
benchmark, and the overlap around each hit is counted token by token. Items that are shorter than the mask
are found by the hash of all their tokens.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import BROADCAST_ROWS, keep_keys, table, written

MASKS = ((0, 1, 3, 6, 7),)
WINDOW, DIFFERENCES = 13, 2
#: Seeds of a broadcast part (24 bytes each), and the parts up to which the documents are read once for each.
SEED_ROWS, MOST_PARTS = 2_000_000, 8


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def masked(mask: tuple[int, ...], number: int):
    """Place and hash of the tokens that the mask reads, laid at token i."""
    return lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(number), *[F.get("tokens", i + p) for p in mask]).alias("seed"))


def seeds(rows: DataFrame, masks, lengths: list[int]) -> DataFrame:
    """rows with an array tokens -> the row's other columns, seed and at, the token where a mask lies.

    lengths are sizes of runs that are hashed whole, as the masks of items that are shorter than every other mask.
    """
    hashes = []
    for number, mask in [*enumerate(masks), *((-n, tuple(range(n))) for n in lengths)]:
        starts = F.size("tokens") - mask[-1]
        hashes.append(F.when(starts > 0, F.transform(F.sequence(F.lit(0), starts - 1), masked(mask, number))).otherwise(F.array().cast("array<struct<at:int,seed:bigint>>")))
    rest = [c for c in rows.columns if c != "tokens"]
    return rows.select(*rest, F.explode(F.concat(*hashes)).alias("s")).select(*rest, "s.at", "s.seed")


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", masks=MASKS, window: int = WINDOW, differences: int = DIFFERENCES) -> DataFrame:
    """(key, item, n_matched, n_windows): documents and the benchmark items that they overlap.

    A document overlaps an item if, laid side by side, window consecutive tokens of both have differences
    substitutions at most; an item of fewer tokens, down to one, has to be in the document whole and unchanged.
    n_windows counts the matching windows, n_matched is the best window's equal tokens. Null and empty texts,
    items without a token, rows with null keys and empty tables give nothing; repeated rows and items are
    counted once; other columns are not looked at. key and item must differ in name.
    """
    items = written(benchmark.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), tokens(F.col(item_text)).alias("words")).distinct(), "items")
    span = min(m[-1] + 1 for m in masks)
    lengths = sorted(r[0] for r in items.select(F.size("words").alias("n")).where((F.col("n") > 0) & (F.col("n") < span)).distinct().collect())  # fewer than span numbers
    # Items that a mask fits are looked for by masks, shorter ones by the hash of all their tokens.
    marked = items.select("item", F.size("words").alias("n"), F.col("words").alias("tokens"))
    wanted = seeds(marked.where(F.col("n") >= span), masks, [])
    for n in lengths:
        wanted = wanted.union(seeds(marked.where(F.col("n") == n), (), [n]))
    wanted = wanted.select("item", F.col("at").alias("item_at"), "seed").distinct()
    n_words = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    if n_words <= BROADCAST_ROWS // 8:
        items = F.broadcast(items)
    docs = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t"))
    laid = seeds(docs.select("id", tokens(F.col("t")).alias("tokens")), masks, lengths)
    # Seeds of the benchmark go to where the documents lie, in parts of a checked size; only a benchmark beyond
    # MOST_PARTS of them makes the documents' seeds travel.
    parts = -(-n_words * len(masks) // SEED_ROWS)
    if parts <= 1:
        hits = laid.join(F.broadcast(wanted), "seed")
    elif parts <= MOST_PARTS:
        wanted = written(wanted, "seeds")
        cut = [laid.join(F.broadcast(wanted.where(F.pmod("seed", F.lit(parts)) == i)), "seed") for i in range(parts)]
        hits = reduce(DataFrame.union, cut)
    else:
        hits = laid.join(wanted, "seed")
    hits = written(hits.select("id", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "hits")
    found = keep_keys(docs, hits.select("id").distinct(), "id").select("id", tokens(F.col("t")).alias("tokens"))
    found = found.join(hits, "id").join(items, "item")
    lo, hi = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("words"), F.size("tokens") - F.col("shift"))
    found = found.select("id", "item", F.size("words").alias("n"), F.slice("words", lo + 1, hi - lo).alias("w"), F.slice("tokens", lo + F.col("shift") + 1, hi - lo).alias("t"))
    found = found.withColumn("same", F.zip_with("w", "t", lambda a, b: (a == b).cast("int")))
    # Whole windows for long items, the whole item for short ones.
    size = F.least(F.lit(window), F.col("n"))
    need = F.when(F.col("n") >= window, F.lit(window - differences)).otherwise(F.col("n"))
    found = found.withColumns({"size": size, "need": need})
    starts = F.size("same") - F.col("size")
    count = lambda i: F.aggregate(F.slice("same", i + 1, F.col("size")), F.lit(0), lambda n, x: n + x)
    found = found.withColumn("counts", F.when(starts >= 0, F.transform(F.sequence(F.lit(0), starts), count)))
    found = found.withColumn("good", F.filter("counts", lambda c: c >= F.col("need"))).where(F.size("good") > 0)
    return found.groupBy(F.col("id").alias(key), F.col("item").alias(item)).agg(F.max(F.array_max("good")).cast("long").alias("n_matched"), F.sum(F.size("good")).cast("long").alias("n_windows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the rows whose key overlaps a benchmark item; see overlaps()."""
    bad = written(overlaps(docs, benchmark, key, text, **options).select(key).distinct(), "contaminated")
    few = bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(bad) if few else bad, key, "left_anti").select(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same by plain 4-grams: 13 tokens with two differences have four equal ones in a row. Items of fewer than 13 tokens have to match whole.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
dg AS (SELECT doc_id, p, hash(t[p], t[p + 1], t[p + 2], t[p + 3]) AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 2)) AS p FROM d)),
bg AS (SELECT item_id, p, hash(w[p], w[p + 1], w[p + 2], w[p + 3]) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS p FROM b)),
d1 AS (SELECT doc_id, p, t[p] AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS p FROM d WHERE (SELECT min(len(w)) FROM b) < 4)),
h AS (SELECT DISTINCT doc_id, item_id, dg.p - bg.p AS s FROM dg JOIN bg USING (g) UNION SELECT doc_id, item_id, p - 1 FROM d1 JOIN b ON w[1] = g AND len(w) < 4),
s AS (SELECT doc_id, item_id, s, t, w, least(13, len(w)) AS n, CASE WHEN len(w) >= 13 THEN 11 ELSE len(w) END AS need FROM h JOIN d USING (doc_id) JOIN b USING (item_id)),
x AS (SELECT doc_id, item_id, s, q, need, list_sum([CASE WHEN w[j] = t[j + s] THEN 1 ELSE 0 END FOR j IN range(q, q + n)]) AS c
  FROM (SELECT *, unnest(range(greatest(1, 1 - s), least(len(w), len(t) - s) - n + 2)) AS q FROM s))
SELECT doc_id, item_id, CAST(max(c) AS BIGINT) AS n_matched, CAST(count(*) AS BIGINT) AS n_windows
FROM x WHERE c >= need GROUP BY doc_id, item_id
"""
