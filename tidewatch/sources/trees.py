"""Source trees as a data source: directories are walked in tasks, and only files that pass the filters are opened.

    spark.dataSource.register(SourceTrees)
    spark.read.format("source_trees").load("s3a://trees").where("kind <> 'other' and target = 'a'")

Filters on target, path, kind and size are taken by the reader. Those on the path and the kind keep whole directories from
being listed, those on target and size keep files from being opened. Spark's own binaryFile source takes no filter
that needs the path, and reads all that is small.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from tidewatch.functions.text import CONFIG_EXTENSIONS, IGNORED_DIRS, LOCKFILES, MAX_BYTES, NOTABLE_NAMES, SOURCE_EXTENSIONS

SCHEMA = "target string, version string, path string, size bigint, kind string, content binary"
ARROW = pa.schema([("target", pa.string()), ("version", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("kind", pa.string()), ("content", pa.binary())])
BATCH_BYTES = 8 << 20
COLUMNS = ("target", "path", "kind", "size")


def kind_of(path: str) -> str:
    """code (worth reading), lockfile (only noted) or other, by the path below the target."""
    *above, name = path.split("/")
    if any(d in IGNORED_DIRS for d in above):
        return "other"
    stem, dot, end = name.rpartition(".")
    extension = f".{end.lower()}" if dot and stem.strip(".") else ""
    if extension in SOURCE_EXTENSIONS or extension in CONFIG_EXTENSIONS or name in NOTABLE_NAMES:
        return "code"
    return "lockfile" if name.lower() in LOCKFILES else "other"


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address, and the folder's path there."""
    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(root)
    if root.startswith("file:") and not root.startswith("file://"):
        root = "file://" + root[5:]
    system, path = fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1))
    return system, path.rstrip("/")


def open_file(system: fs.FileSystem, path: str, most: int) -> bytes:
    with system.open_input_stream(path) as f:
        return f.read(most)


@dataclass
class Unit(InputPartition):
    """Targets, or directories of one target, that a task walks; flat ones are not walked below themselves."""

    places: list[tuple[str, str, bool]]  # target, directory below it, flat


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.version = options["path"], options.get("version", "head")
        self.most, self.per_task, self.split = int(options.get("most_bytes", MAX_BYTES)), max(1, int(options.get("targets_per_task", 16))), options.get("split_targets", "false").lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {EqualTo: "=", In: "in", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">=", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "contains"}
        for f in filters:
            column = getattr(f, "attribute", getattr(getattr(f, "child", None), "attribute", ()))
            if len(column) == 1 and column[0] in COLUMNS:
                if isinstance(f, IsNotNull):
                    continue  # they never are
                if type(f) in kinds:
                    self.tests.append((column[0], kinds[type(f)], f.value))
                    continue
                if isinstance(f, Not) and type(f.child) in (EqualTo, In):
                    self.tests.append((column[0], "not " + kinds[type(f.child)], f.child.value))
                    continue
            yield f

    def passes(self, **values: object) -> bool:
        """Whether what is known of a file (target, path, kind, size, or some of them) passes the filters on it."""
        for column, sign, wanted in self.tests:
            if column in values:
                v = values[column]
                is_in = v == wanted if sign.endswith("=") and len(sign) < 3 or sign == "not =" else v in wanted if sign in ("in", "not in") else None
                ok = {"=": is_in, "in": is_in, "not =": not is_in, "not in": not is_in}.get(sign)
                if ok is None:
                    ok = {"<": lambda: v < wanted, "<=": lambda: v <= wanted, ">": lambda: v > wanted, ">=": lambda: v >= wanted, "starts": lambda: v.startswith(wanted), "ends": lambda: v.endswith(wanted), "contains": lambda: wanted in v}[sign]()
                if not ok:
                    return False
        return True

    def may_hold(self, directory: str) -> bool:
        """Whether a file below a directory (ending in /) can pass the filters on path and kind."""
        if any(part in IGNORED_DIRS for part in directory.split("/")) and not self.passes(kind="other"):
            return False
        for column, sign, wanted in self.tests:
            if column == "path" and sign == "starts" and not (wanted.startswith(directory) or directory.startswith(wanted)):
                return False
            if column == "path" and sign in ("=", "in") and not any(w.startswith(directory) for w in ([wanted] if sign == "=" else wanted)):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        system, root = file_system(self.root)
        below = lambda found: sorted(i.base_name for i in found if i.type == fs.FileType.Directory and not is_link(system, i.path))
        targets = [t for t in below(system.get_file_info(fs.FileSelector(root))) if self.passes(target=t)]
        if not self.split:
            return [Unit([(t, "", False) for t in targets[i : i + self.per_task]]) for i in range(0, len(targets), self.per_task)] or [Unit([])]

        def places(target: str) -> list[tuple[str, str, bool]]:
            inside = below(listed(system, f"{root}/{target}") or [])
            return [(target, "", True), *((target, f"{d}/", False) for d in inside if self.may_hold(f"{d}/"))]

        with ThreadPoolExecutor(16) as pool:
            return [Unit([p]) for some in pool.map(places, targets) for p in some] or [Unit([])]

    def read(self, unit: Unit) -> Iterator[pa.RecordBatch]:
        system, root = file_system(self.root)
        rows: list[tuple] = []
        held = 0
        for target, directory, flat in unit.places:
            for row in self.walk(system, root, target, directory, flat):
                rows.append(row)
                held += len(row[-1] or b"") + 100
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    def walk(self, system: fs.FileSystem, root: str, target: str, directory: str, flat: bool) -> Iterator[tuple]:
        """The files of a directory, then those of its subdirectories, each in order. Links are not followed."""
        found = listed(system, f"{root}/{target}/{directory}".rstrip("/"))
        if found is None:  # it cannot be listed: what it holds is not known, which is said by a row of its own
            if self.passes(target=target, path=directory, kind="code", size=0):
                yield target, self.version, directory, 0, "code", None
            return
        inside = []
        for i in sorted(found, key=lambda i: i.base_name):
            path = directory + i.base_name
            if is_link(system, i.path):
                continue
            if i.type == fs.FileType.Directory:
                inside.append(path + "/")
                continue
            kind, size = kind_of(path), max(0, i.size or 0)
            if not self.passes(target=target, path=path, kind=kind, size=size):
                continue
            content = None
            if i.type == fs.FileType.File and size <= self.most:
                try:
                    content = open_file(system, i.path, self.most)
                except OSError:
                    content = None
            yield target, self.version, path, size, kind, content
        if not flat:
            for d in inside:
                if self.may_hold(d):
                    yield from self.walk(system, root, target, d, False)


def is_link(system: fs.FileSystem, path: str) -> bool:
    return isinstance(system, fs.LocalFileSystem) and os.path.islink(path)


def listed(system: fs.FileSystem, path: str) -> list[fs.FileInfo] | None:
    try:
        return system.get_file_info(fs.FileSelector(path))
    except OSError:
        return None


class SourceTrees(DataSource):
    """(target, version, path, size, kind, content) of the files below path/<target>/.

    Options: version, most_bytes (larger files keep their size and have no content), targets_per_task, split_targets (a task for
    each directory of a target, for trees that are large each). A file that cannot be opened has a null content,
    which readability calls unreadable; a directory that cannot be listed is a row of its own with path/ as its path.
    """

    @classmethod
    def name(cls) -> str:
        return "source_trees"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options))


def trees(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """The data source over root, with its filters on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTrees)
    return spark.read.format("source_trees").options(**{k: str(v) for k, v in options.items()}).load(root)


def write_trees(files: DataFrame, root: str) -> int:
    """Writes rows (target, path, content) as files below root/<target>/, in tasks; returns how many.

    Rows with a null in any of the three are passed over; a path that would leave its target raises. Writing again
    replaces, so a repeated task does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = file_system(root)
        n, made = 0, set()
        for batch in batches:
            for row in batch.to_pylist():
                target, path, content = row["target"], row["path"], row["content"]
                if target is None or path is None or content is None:
                    continue
                if any(p in ("", ".", "..") for p in (target, *path.split("/"))) or "/" in target:
                    raise ValueError(f"not a path below a target: {target}/{path}")
                full = f"{folder}/{target}/{path}"
                above = full.rpartition("/")[0]
                if above not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                with system.open_output_stream(full) as f:
                    f.write(content)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return files.select("target", "path", "content").mapInArrow(run, "n bigint").groupBy().sum("n").first()[0] or 0
