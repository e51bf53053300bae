import json
import os

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.versions import version_key
from tidewatch.operators import diff, findings
from tidewatch.sources import readers, report_files


def test_versions_in_the_order_of_their_values(spark):
    order = ["head", "0.9", "1.2", "1.9", "v1.10", "1.10.1", "2.0-alpha2", "2.0-beta", "2.0-rc1", "2.0-rc2", "2.0", "2.0.post1", "2.0.1", "2.0.10", "010", "20240101", "99999999999999999999999"]
    frame = spark.createDataFrame([(v,) for v in reversed(order)] + [(None,)], "v string")
    assert [r.v for r in frame.orderBy(version_key(F.col("v"))).collect()] == [None, *order]
    sets = spark.createDataFrame([("t", v, "capability", i) for v, i in (("1.10", "b"), ("1.9", "a"), ("2.0", "c"), ("2.0-rc1", "b"))], "target string, version string, kind string, item string")
    assert {r.version: (r.added, r.removed) for r in diff.version_drift(sets).collect()} == {"1.9": (["a"], []), "1.10": (["b"], ["a"]), "2.0-rc1": ([], []), "2.0": (["c"], ["b"])}


@pytest.fixture
def reports(spark):
    rows = [("o/a", "HIGH", [("r.1", [("a.py", 3), ("b.py", None)])], None), ("o/b__c", None, [], "https://x"), ("o/d", "LOW", None, "")]
    return spark.createDataFrame(rows, "target string, overall string, findings array<struct<rule_id:string,evidence:array<struct<path:string,line:int>>>>, source_url string")


def rows(df):
    return sorted(map(repr, (r.asDict(True) for r in df.collect())))


def test_reports_are_read_back_as_they_were_written(spark, reports, tmp_path):
    root = str(tmp_path / "reports")
    report_files.write_report_files(reports, root)
    assert sorted(os.listdir(root)) == ["o__a.json", "o__b__c.json", "o__d.json"]
    assert rows(readers.read_reports(spark, root, reports.schema)) == rows(reports)
    assert json.load(open(f"{root}/o__a.json"))["findings"][0]["evidence"] == [{"path": "a.py", "line": 3}, {"path": "b.py"}]
    assert {(r.target, r.overall) for r in readers.read_reports(spark, root).collect()} == {("o/a", "HIGH"), ("o/b/c", None), ("o/d", "LOW")}


def test_a_commit_writes_all_or_nothing(spark, reports, tmp_path):
    root = str(tmp_path / "reports")
    report_files.write_report_files(reports, root)
    open(f"{root}/_notes.json", "w").write("{}")
    for bad in (reports.union(reports.limit(1)), reports.withColumn("target", F.when(F.col("overall") == "LOW", F.lit(None)).otherwise(F.col("target"))), reports.withColumn("target", F.lit("_x"))):
        with pytest.raises(Exception, match="two reports of one target|needs a target"):
            report_files.write_report_files(bad.withColumn("overall", F.lit("CRITICAL")), root)
        assert rows(readers.read_reports(spark, root, reports.schema)) == rows(reports) and not [x for x in os.listdir(root) if x.startswith("_writing")]
    report_files.write_report_files(reports.where("target = 'o/a'").withColumn("overall", F.lit("LOW")), root, "append")
    assert len([x for x in os.listdir(root) if x.startswith("o__")]) == 3
    report_files.write_report_files(reports.where("target = 'o/a'"), f"file://{root}")
    assert sorted(os.listdir(root)) == ["_notes.json", "o__a.json"]
    report_files.write_report_files(reports.limit(0), root)
    assert os.listdir(root) == ["_notes.json"]


@pytest.mark.parametrize("split", ["134217728", "700"])
def test_registry_rows_are_numbered_as_they_stand(spark, tmp_path, split):
    for name, first in (("a.json", 0), ("b.json", 40)):
        (tmp_path / name).write_text("".join(json.dumps({"server": {"name": f"n{first + i}", "description": "x" * (i % 7 * 30)}, "_meta": {"m": {"isLatest": True}}}) + "\n" for i in range(40)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = [r.name for r in readers.read_registry(spark, str(tmp_path), "m").orderBy("seq").collect()]
        assert got == [f"n{i}" for i in range(80)] and [r.seq for r in readers.read_registry(spark, str(tmp_path), "m").orderBy("seq").collect()] == list(range(80))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_totals_and_alarms_of_a_fleet(spark):
    e = lambda *paths: [(p, 1, None, None, None) for p in paths]
    data = [("a", "v", "r1", "HIGH", "LOW", "t", e("src/x.py", "tests/y.py", "z.py")), ("a", "v", "r2", "CRITICAL", "LOW", "t", e("tests/y.py")), ("a", "v", "r3", "CRITICAL", "HIGH", "t", []), ("b", "v", "r1", "LOW", "LOW", "t", e(None, "docs/a.md"))]
    found = spark.createDataFrame(data, "target string, version string, rule_id string, severity string, confidence string, title string, evidence array<struct<path:string,line:int,snippet:string,detail:string,context:string>>")
    totals = {(r.place, r.severity): (r.n, r.share) for r in findings.fleet_totals(found).collect()}
    assert totals[None, None] == (4, 1.0) and totals["outside", "CRITICAL"] == (1, 0.25) and sum(n for (p, s), (n, _) in totals.items() if p and s is None) == 4
    alarms = {(r.rule_id, tuple(r.paths)) for r in findings.shipped_alarms(found).collect()}
    assert alarms == {("r1", ("src/x.py", "tests/y.py")), ("r3", ())}
    verdicts = spark.createDataFrame([("a", "v", "CRITICAL"), ("b", "v", "LOW"), ("c", "v", None)], "target string, version string, overall string")
    assert {(r.overall, r.n_targets) for r in findings.verdict_distribution(verdicts).collect()} == {("CRITICAL", 1), ("LOW", 1), ("NOT_FLAGGED", 1)}
    down = {r.target: (r.n_alarms, [x.rule_id for x in r.alarms]) for r in findings.worst_drilldown(verdicts, found, 2, 1).collect()}
    assert down == {"a": (2, ["r3"]), "b": (0, [])}
    assert findings.fleet_totals(found.limit(0)).count() == 0 and findings.worst_drilldown(verdicts.limit(0), found, 2).count() == 0
