"""Inputs as DataFrames: source trees, repository metadata, registry snapshots, reports, target lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.functions.shared import saved
from tidewatch.functions.text import MAX_BYTES, sanitize
from tidewatch.sources.trees import trees

REPO_SCHEMA = "full_name STRING, description STRING, html_url STRING, stargazers_count BIGINT, forks_count BIGINT, created_at STRING, pushed_at STRING, archived BOOLEAN, license STRUCT<name:STRING>, owner STRUCT<type:STRING,login:STRING>, open_issues_count BIGINT, default_branch STRING, topics ARRAY<STRING>, homepage STRING, fork BOOLEAN, disabled BOOLEAN, size BIGINT"
REGISTRY_SCHEMA = "server STRUCT<name:STRING,description:STRING,version:STRING,repository:STRUCT<url:STRING,source:STRING>,websiteUrl:STRING,packages:ARRAY<STRUCT<registryType:STRING,identifier:STRING,version:STRING,transport:STRUCT<type:STRING>,environmentVariables:ARRAY<STRUCT<name:STRING>>>>,remotes:ARRAY<STRUCT<type:STRING,url:STRING>>>, _meta MAP<STRING,STRUCT<status:STRING,isLatest:BOOLEAN,publishedAt:STRING,updatedAt:STRING>>"
REPORT_SCHEMA = "overall STRING, findings ARRAY<STRUCT<rule_id:STRING,area:STRING,severity:STRING,confidence:STRING,title:STRING,evidence:ARRAY<STRUCT<path:STRING,line:INT,snippet:STRING,detail:STRING,context:STRING>>>>"


def read_source_trees(spark: SparkSession, root: str, version: str = "head", most_bytes: int = MAX_BYTES, **options: object) -> DataFrame:
    """(target, version, path, size, content) of every file below root/<target>/ that is worth reading, and of lockfiles.

    Directories are walked in tasks; ignored ones are not listed, other files never opened, and larger ones come with null
    content and their size. Later filters on target, path and size are taken by the reader, too. A file that cannot be
    opened has a null content, so that its readability is unreadable. Links are not followed. options are those of
    sources.trees.SourceTrees.
    """
    files = trees(spark, root, version=version, most_bytes=most_bytes, **options)
    return files.where(F.col("kind").isin("code", "lockfile")).drop("kind")


def read_repo_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Repositories with plain columns, and the rejected rows, which name no repository."""
    raw = spark.read.schema(REPO_SCHEMA).json(path)
    good = raw.where(F.coalesce("full_name", F.lit("")) != "")
    flat = good.select(
        sanitize(F.col("full_name")).alias("full_name"), sanitize(F.col("description")).alias("description"), "html_url",
        F.coalesce("stargazers_count", F.lit(0)).alias("stars"), F.coalesce("forks_count", F.lit(0)).alias("forks"), "created_at", "pushed_at",
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("archived", "fork", "disabled")], sanitize(F.col("license.name")).alias("license_name"), F.col("license").isNull().alias("no_license"),
        sanitize(F.col("owner.login")).alias("owner_login"), F.col("owner.type").alias("owner_type"), F.coalesce("open_issues_count", F.lit(0)).alias("open_issues"), "default_branch", F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), "homepage", "size",
    )
    return flat.withColumn("license", F.when(~F.col("no_license"), F.col("license_name"))).drop("no_license", "license_name"), raw.where(F.coalesce("full_name", F.lit("")) == "")


def read_registry(spark: SparkSession, path: str, meta_key: str) -> DataFrame:
    """Registry entries with packages, remotes, transports and whether there is only a remote side.

    seq is the number of the row, from 0, in the snapshot: files by path, rows as they stand in them, however the files are split.
    """
    raw = numbered(spark.read.schema(REGISTRY_SCHEMA).json(path), "seq")
    meta = F.col("_meta")[meta_key]
    found = F.concat(F.transform(F.coalesce("server.packages", F.array()), lambda p: p["transport"]["type"]), F.transform(F.coalesce("server.remotes", F.array()), lambda r: r["type"]))
    has = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)) > 0
    return raw.select(
        sanitize(F.col("server.name")).alias("name"), sanitize(F.col("server.description")).alias("description"), F.col("server.version").alias("version"), F.col("server.repository.url").alias("repository_url"),
        F.col("server.packages").alias("packages"), F.transform("server.remotes", lambda r: F.concat(F.coalesce(r["type"], F.lit("unknown")), F.lit(": "), r["url"])).alias("remotes"),
        F.array_sort(F.array_distinct(F.filter(found, lambda t: F.coalesce(t, F.lit("")) != ""))).alias("transports"), (has("server.remotes") & ~has("server.packages")).alias("is_remote_only"),
        meta["status"].alias("status"), meta["isLatest"].alias("is_latest"), meta["publishedAt"].alias("published_at"), meta["updatedAt"].alias("updated_at"), "seq",
    )


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows of files with their number over all files: rows before the block that a row lies in, plus its place there.

    The rows are written once, as their places in a task have to stay what they are; the blocks are counted, not the rows moved.
    """
    placed = saved(rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place")), "rows")
    blocks = placed.groupBy("_file", "_block").agg(F.min("_place").alias("_from"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))  # one row a block of the input
    return placed.join(blocks.withColumn("_before", F.coalesce(before, F.lit(0))), ["_file", "_block"]).withColumn(name, F.col("_before") + F.col("_place") - F.col("_from")).select(*rows.columns, name)


def read_reports(spark: SparkSession, path: str, schema: StructType | str = REPORT_SCHEMA) -> DataFrame:
    """Report files named owner__repo.json with the target from their name; names that begin with _ are none.

    schema says what is read of a report, (overall, findings) by default; with the schema of what write_reports() was given
    the result is that. A target in the schema is the report's own, which no file name has to spell.
    """
    shape = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.schema(shape).option("multiLine", True).json(path).select("*", F.col("_metadata.file_name").alias("_name"))
    raw = raw.where(~F.col("_name").startswith("_") & F.col("_name").endswith(".json"))
    named = F.replace(F.regexp_replace("_name", r"\.json$", ""), F.lit("__"), F.lit("/"))
    if "target" in shape.names:
        return raw.withColumn("target", F.coalesce("target", named)).drop("_name")
    return raw.select(named.alias("target"), *shape.names)


def read_target_list(spark: SparkSession, path: str) -> DataFrame:
    """(value): owner/repo, one a line; blank lines, comments and names with . or .. segments are dropped."""
    rows = spark.read.text(path).select(F.trim("value").alias("value"))
    return rows.where(F.col("value").rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$") & ~F.col("value").rlike(r"(^|/)\.{1,2}(/|$)"))
