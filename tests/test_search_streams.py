import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.operators import metadata
from tidewatch.streaming import streams


def plain(entries, queries, most):
    out = []
    for query in queries:
        if query is None:
            continue
        words = [w for w in query.strip(" ").lower().split() if len(w) > 2] or [query.strip(" ")]
        hits = []
        for name, description in entries:
            if name is not None and any(w in name.lower() for w in words[:4]):
                text = f"{name} {description}".lower() if description is not None else name.lower()
                hits.append((-sum(w in text for w in words), name))
        out += [(query, name, -score, place) for place, (score, name) in enumerate(sorted(hits)[:most], 1)]
    return sorted(out)


def test_search_is_every_name_looked_at(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcs") for _ in range(rng.randint(1, 5)))
    entries = [(f"srv-{word()}-{word()}", rng.choice([None, word(), f"{word()} {word()}"])) for _ in range(150)] + [("SRV-Éa", "x"), (None, "srv"), ("a", "b"), ("", None)]
    entries = [e for i, e in enumerate(entries) if e[0] not in {x[0] for x in entries[:i]}]
    queries = [" ".join(word() for _ in range(rng.randint(1, 6))) for _ in range(40)] + ["srv", "Srv abc", "a", "AB", "", "  ", None, "zzz nothing", "srv-", "Éa", "éa-x"]
    queries = list(dict.fromkeys(queries))
    frame, asked = spark.createDataFrame(entries, "name string, description string"), spark.createDataFrame([(q,) for q in queries], "query string")
    for most in (3, 500):
        got = metadata.search_registry(frame, asked, most)
        assert sorted(map(tuple, got.collect())) == plain(entries, queries, most)
    assert metadata.search_registry(frame.limit(0), asked).count() == 0 == metadata.search_registry(frame, asked.limit(0)).count()


def test_search_joins_by_equality(spark):
    frame = spark.createDataFrame([("srv-abc", "x"), ("srv-abd", None)], "name string, description string")
    plan = metadata.search_registry(frame, spark.createDataFrame([("srv abc",)], "query string"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    twice = frame.union(frame)
    assert metadata.search_registry(twice, spark.createDataFrame([("srv abc",)], "query string"), 9).count() == 4


AT = datetime(2024, 1, 1)
SCHEMA = "target string, capability string, ts timestamp"


def run(spark, folder, name, batches, accepted=None):
    """Each batch is a run of the stream of its own, started again from the checkpoint."""
    source, sink = folder / f"{name}-in", folder / f"{name}-out"
    source.mkdir()
    seen = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        q = streams.stream_new_capabilities(stream, accepted).writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", str(folder / f"{name}-c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = sorted(tuple(r) for r in spark.read.schema("target string, capability string, first_seen timestamp").parquet(str(sink)).collect())
        seen.append(got)
    return seen


def test_new_capabilities_over_all_time(spark, tmp_path):
    h = lambda n: AT + timedelta(hours=n)
    first = [("a", "net", h(3)), ("a", "net", h(2)), ("a", "exec", h(5)), (None, "net", h(1)), ("b", None, h(1)), ("c", "old", h(1))]
    second = [("a", "net", h(1)), ("a", "net", h(2)), ("b", "net", h(900)), ("b", "net", h(900))]  # late, repeated, new
    accepted = spark.createDataFrame([("c", "old"), ("c", "old"), ("d", "net")], "target string, capability string")
    one, two, three = run(spark, tmp_path, "x", [first, second, [("d", "net", h(1)), ("c", "new", None)]], accepted)
    assert one == [("a", "exec", h(5)), ("a", "net", h(2))]
    assert two == [*one, ("b", "net", h(900))]
    assert three == sorted([*two, ("c", "new", None)], key=lambda r: r[:2])


def test_without_a_baseline_all_is_new(spark, tmp_path):
    got = run(spark, tmp_path, "y", [[("a", "net", AT)], [("a", "net", AT)]])
    assert got == [[("a", "net", AT)]] * 2
