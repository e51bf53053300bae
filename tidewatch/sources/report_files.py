"""Reports as files of their own: one JSON file a target, all of them or none.

Tasks write to a folder beside the reports; only the commit moves the files to their names. A job that fails leaves
what was there before, a task that runs twice writes the same file twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tidewatch.sources.trees import file_system


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]  # where the task put it, what it is to be called


class ReportWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.attempt = path, overwrite, f"_writing-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, root = file_system(self.path)
        folder, names = f"{root}/{self.attempt}/{uuid.uuid4().hex[:12]}", []
        for n, row in enumerate(iterator):
            if not n:
                system.create_dir(folder, recursive=True)
            place = f"{folder}/{n}.json"
            with system.open_output_stream(place) as f:
                f.write(row["report"].encode())
            names.append((place, row["name"]))
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = file_system(self.path)
        files = [x for m in messages if m is not None for x in m.names]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"two reports of one target: {next(n for n in names if names.count(n) > 1)}")
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(root)):
                if old.type == fs.FileType.File and old.base_name.endswith(".json") and old.base_name[0] != "_" and old.base_name not in set(names):
                    system.delete_file(old.path)
        for place, name in files:
            system.move(place, f"{root}/{name}")
        self.clear(system, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.clear(*file_system(self.path))

    def clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{self.attempt}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.attempt}")


class ReportFiles(DataSource):
    """Rows (name, report) as files of these names and contents; mode append replaces files of the same name, overwrite all reports."""

    @classmethod
    def name(cls) -> str:
        return "report_files"

    def schema(self) -> str:
        return "name string, report string"

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"], overwrite)


def write_report_files(reports: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes each row (target and more) as path/owner__repo.json, which readers.read_reports() reads back.

    Nulls are left out of the JSON and come back as nulls. A null or empty target, one that begins with _, or two rows of
    one target raise, and nothing is written then. Without rows there are no files.
    """
    spark = reports.sparkSession
    spark.dataSource.register(ReportFiles)
    bad = F.coalesce(F.col("target"), F.lit("")).rlike(r"^(_.*)?$")
    named = F.when(bad, F.raise_error(F.lit("a report needs a target that does not begin with _"))).otherwise(F.concat(F.replace(F.col("target"), F.lit("/"), F.lit("__")), F.lit(".json")))
    reports.select(named.cast("string").alias("name"), F.to_json(F.struct(*reports.columns)).alias("report")).write.format("report_files").mode(mode).save(path)
