import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, LessThanOrEqual, Not, StringStartsWith

from tidewatch.operators import files
from tidewatch.plans import audit
from tidewatch.sources import readers, trees

TREE = {
    "one/server.py": b"import os\n", "one/node_modules/a.py": b"x", "one/node_modules/yarn.lock": b"x", "one/docs/a.md": b"# a", "one/img/logo.png": b"\x89PNG", "one/sub/yarn.lock": b"lock", "one/Build/b.js": b"1", "one/big.py": b"#" * 400,
    "two/.bashrc": b"x", "two/Makefile": b"all:", "two/package-lock.json": b"{}", "two/a/b/c/d.TS": b"1", "two/.env.local": b"K=1", "two/dist/x.js": b"1",
}
KINDS = {"server.py": "code", "node_modules/a.py": "other", "node_modules/yarn.lock": "other", "docs/a.md": "code", "img/logo.png": "other", "sub/yarn.lock": "lockfile", "Build/b.js": "code", "big.py": "code", ".bashrc": "other", "Makefile": "code", "package-lock.json": "code", "a/b/c/d.TS": "code", ".env.local": "other", "dist/x.js": "other"}


@pytest.fixture
def root(tmp_path):
    for path, content in TREE.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    os.symlink("/etc", tmp_path / "one" / "etc")
    os.symlink("/etc/hostname", tmp_path / "one" / "host.py")
    os.symlink(tmp_path / "one", tmp_path / "linked")
    return str(tmp_path)


@pytest.fixture
def opened(monkeypatch):
    seen, real = [], trees.open_file
    monkeypatch.setattr(trees, "open_file", lambda system, path, most: seen.append(path) or real(system, path, most))
    return seen


def read(root, *filters, **options):
    reader = trees.TreeReader({"path": root, **options})
    left = list(reader.pushFilters(list(filters)))
    return left, [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def test_kinds(spark):
    assert {p: trees.kind_of(p) for p in KINDS} == KINDS
    frame = spark.createDataFrame([("t", "v", p) for p in KINDS], "target string, version string, path string")
    assert {r.path for r in files.worth_reading(frame).collect()} == {p for p, k in KINDS.items() if k == "code"}
    assert {(r.name, r.path) for r in files.noted_lockfiles(frame).collect()} == {("yarn.lock", "sub/yarn.lock"), ("package-lock.json", "package-lock.json")}


@pytest.mark.parametrize("split", ["false", "true"])
def test_only_what_passes_is_opened(root, opened, split):
    left, rows = read(root, In(("kind",), ("code", "lockfile")), EqualTo(("target",), "one"), LessThanOrEqual(("size",), 300), split_targets=split)
    assert left == [] and sorted(r[2] for r in rows) == ["Build/b.js", "docs/a.md", "server.py", "sub/yarn.lock"]
    assert sorted(os.path.relpath(p, root) for p in opened) == ["one/Build/b.js", "one/docs/a.md", "one/server.py", "one/sub/yarn.lock"]
    assert all(r[5] == TREE[f"one/{r[2]}"] and r[3] == len(r[5]) for r in rows)


def test_directories_that_cannot_hold_a_file_are_not_listed(root, monkeypatch):
    seen, real = [], trees.listed
    monkeypatch.setattr(trees, "listed", lambda system, path: seen.append(os.path.relpath(path, root)) or real(system, path))
    read(root, In(("kind",), ("code", "lockfile")))
    assert not {"one/node_modules", "two/dist", "one/etc", "linked"} & set(seen) and "two/a/b/c" in seen
    seen.clear()
    _, rows = read(root, StringStartsWith(("path",), "a/b/"))
    assert {r[2] for r in rows} == {"a/b/c/d.TS"} and not {"one/docs", "two/dist"} & set(seen)


def test_larger_files_keep_their_size_and_are_not_opened(root, opened):
    _, rows = read(root, EqualTo(("path",), "big.py"), most_bytes="300")
    assert rows == [("one", "head", "big.py", 400, "code", None)] and opened == []


def test_filters_that_are_not_taken_are_left_to_spark(root):
    odd = [EqualTo(("content",), b"x"), Not(LessThanOrEqual(("size",), 3)), Not(EqualTo(("kind",), "other"))]
    left, rows = read(root, *odd)
    assert left == odd[:2] and {r[4] for r in rows} == {"code", "lockfile"}


def test_a_file_that_raises_is_unreadable_and_so_is_a_directory(spark, root, monkeypatch):
    real = trees.open_file

    def refuse(system, path, most):
        if path.endswith("server.py"):
            raise PermissionError(path)
        return real(system, path, most)

    monkeypatch.setattr(trees, "open_file", refuse)
    list_real = trees.listed
    monkeypatch.setattr(trees, "listed", lambda system, path: None if path.endswith("/docs") else list_real(system, path))
    _, rows = read(root, Not(EqualTo(("kind",), "other")), EqualTo(("target",), "one"))
    frame = spark.createDataFrame(rows, trees.SCHEMA)
    status = {r.path: r.status for r in files.classify_readability(frame).collect()}
    assert status["server.py"] == status["docs/"] == "unreadable" and status["Build/b.js"] == "ok"


def test_spark_reads_the_same_and_pushes_filters(spark, root):
    got = {(r.target, r.path): (r.size, r.content and bytes(r.content)) for r in readers.read_source_trees(spark, root, most_bytes=300, targets_per_task=1).collect()}
    assert got == {("one" if f"one/{p}" in TREE else "two", p): (len(c), None if len(c) > 300 else c) for p, k in KINDS.items() if k != "other" for c in [TREE.get(f"one/{p}", TREE.get(f"two/{p}"))]}
    some = readers.read_source_trees(spark, root).where("target = 'two' and size < 3 and path not like '%.TS'").select("path")
    assert [r.path for r in some.collect()] == ["package-lock.json"]
    plan = readers.read_source_trees(spark, root).where("target = 'two'").select("path")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan  # all of it is the reader's
    os.mkdir(f"{root}/empty")
    assert spark.createDataFrame([], "x int").count() == 0 and readers.read_source_trees(spark, f"{root}/empty").count() == 0


def test_trees_that_are_written_are_read_back(spark, tmp_path):
    rows = [("a", "x/y.py", bytearray(b"1")), ("b", "z.md", bytearray(b"")), ("a", None, bytearray(b"2")), ("c", "q.py", None)]
    frame = spark.createDataFrame(rows, "target string, path string, content binary")
    assert trees.write_trees(frame, str(tmp_path)) == 2 and trees.write_trees(frame, f"file://{tmp_path}") == 2
    assert sorted((r.target, r.path, bytes(r.content)) for r in readers.read_source_trees(spark, f"file://{tmp_path}").collect()) == [("a", "x/y.py", b"1"), ("b", "z.md", b"")]
    with pytest.raises(Exception, match="not a path below a target"):
        trees.write_trees(spark.createDataFrame([("a", "../b.py", bytearray(b""))], "target string, path string, content binary"), str(tmp_path))


def audited(spark, rows, most=None):
    frame = spark.createDataFrame([("t", "v", p, len(c or b""), None if c is None else bytearray(c)) for p, c in rows], "target string, version string, path string, size long, content binary")
    found, verdicts, coverage = audit.audit_targets(frame, most_files=most)
    return found.collect(), verdicts.collect(), coverage.collect()


def test_a_lockfile_alone_is_noted_and_not_audited(spark):
    found, verdicts, coverage = audited(spark, [("yarn.lock", b'resolved "https://webhook.site/x"\n')])
    assert found == [] and [(r.n_ok, r.exit_code) for r in coverage] == [(0, 4)] and [r.exit_code for r in verdicts] == [4]


def test_the_cap_counts_what_can_be_read(spark):
    tree = [("a.py", b"x = 1\n"), ("b.py", b"#" * (600 * 1024)), ("c.py", b"import os\n"), ("d.png.js", b"\0"), ("sub/e.py", b"import os\n")]
    frame = files.classify_readability(spark.createDataFrame([("t", "v", p, len(c), bytearray(c)) for p, c in tree], "target string, version string, path string, size long, content binary"))
    got = lambda n: sorted((r.path, r.status, r.hit_file_limit) for r in files.readable_cap(frame, n).collect())
    assert got(2) == [("a.py", "ok", True), ("b.py", "large", True), ("c.py", "ok", True)]
    assert got(1) == [("a.py", "ok", True)] and got(0) == []
    assert [x[2] for x in got(3)] == [False] * 5 == [x[2] for x in got(9)]
    _, _, coverage = audited(spark, [(p, c) for p, c in tree], most=2)
    assert [(r.n_ok, r.n_large, r.n_binary, r.hit_file_limit) for r in coverage] == [(2, 1, 0, True)]


def test_the_cap_sends_the_first_places_of_each_task_only(spark):
    frame = spark.range(100_000).select(F.concat(F.lit("t"), F.col("id") % 3).alias("target"), F.lit("v").alias("version"), F.concat(F.lit("f"), "id").alias("path"), F.lit("ok").alias("status"))
    assert "WindowGroupLimit" in files.readable_cap(frame, 1500)._jdf.queryExecution().executedPlan().toString()
