"""Files to lines: selection, readability, line numbering, caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import text as t
from tidewatch.functions.unions import union_all

FILE = ("target", "version", "path")


def select_scannable(files: DataFrame) -> DataFrame:
    """Files worth reading, plus lockfiles, which are noted whatever their size or extension."""
    return files.withColumn("is_lockfile", t.is_lockfile(F.col("path"))).where(t.is_scannable(F.col("path")) | F.col("is_lockfile"))


def classify_readability(files: DataFrame) -> DataFrame:
    """files (content BINARY, size) with status ok, large, unreadable or binary."""
    return files.withColumn("status", t.readability(F.col("content"), F.col("size")))


def explode_lines(files: DataFrame) -> DataFrame:
    """(target, version, path, line, text) of the readable files, from 1, sanitized. Lines are never cut."""
    text = F.col("text") if "text" in files.columns else t.decoded(F.col("content"))
    lines = files.select(*FILE, F.posexplode(t.lines_array(t.sanitize(text))).alias("at", "text"))
    return lines.select(*FILE, (F.col("at") + 1).alias("line"), "text")


def shallowest_manifest(files: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """The file nearest the root for each target, version and lower-case name; of equals the first by path."""
    files = files.withColumn("name", F.lower(t.basename(F.col("path"))))
    if names:
        files = files.where(F.col("name").isin(*names))
    w = Window.partitionBy("target", "version", "name").orderBy(F.size(F.split("path", "/")), "path")
    return files.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def file_cap(files: DataFrame, most: int) -> DataFrame:
    """The first files of each target in walk order, and whether there are more."""
    keys = ["target", "version"]
    keyed = files.withColumn("key", t.walk_key(F.col("path")))
    first = keyed.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("key"))).where(F.col("rn") <= most)
    counts = files.groupBy(*keys).agg((F.count("*") > most).alias("hit_file_limit"))
    return first.join(counts, keys).select(*files.columns, "hit_file_limit")


def noted_lockfiles(files: DataFrame) -> DataFrame:
    """(target, version, name, path): lockfiles outside ignored directories, by lower-case name; each is noted, whether or not it can be read."""
    in_reach = ~F.arrays_overlap(t.directories(F.col("path")), F.array(*map(F.lit, t.IGNORED_DIRS)))
    return files.where(t.is_lockfile(F.col("path")) & in_reach).select("target", "version", F.lower(t.basename(F.col("path"))).alias("name"), "path")


def worth_reading(files: DataFrame) -> DataFrame:
    """The files that an audit reads: a lockfile only if its extension is one that is read anyway."""
    return files.where(t.is_scannable(F.col("path")))


def readable_cap(files: DataFrame, most: int) -> DataFrame:
    """files (with their status) up to the most-th readable one of each target in walk order, and hit_file_limit.

    What cannot be read costs nothing and is kept where it comes before that file; what comes after it is left out, and a
    target that had any such file has hit_file_limit. A task sends at most the first readable places of each target, so
    no target gathers in one task. Rows that repeat a path count once each. With most 0 nothing is left.
    """
    spark = files.sparkSession
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", max(most + 1, int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))))
    keys = ["target", "version"]
    keyed = files.withColumn("walk", t.walk_key(F.col("path")))
    first = keyed.where("status = 'ok'").select(*keys, "walk").withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("walk"))).where(F.col("rn") <= most)
    full = first.groupBy(*keys).agg(F.max("walk").alias("reach"), F.count("*").alias("n")).where(F.col("n") == most)
    last = keyed.groupBy(*keys).agg(F.max("walk").alias("end"))
    if most <= 0:
        full = last.select(*keys, F.array().cast("array<string>").alias("reach"))
    limits = last.join(full, keys, "left").select(*keys, "reach", F.coalesce(F.col("end") > F.col("reach"), F.lit(False)).alias("hit_file_limit"))
    return keyed.join(limits, keys).where("reach is null or walk <= reach").drop("walk", "reach")


def scan_coverage(files: DataFrame) -> DataFrame:
    """Counts by status for each target; exit code 4 where nothing could be read: not looked at is never clean."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    limit = F.bool_or(F.coalesce("hit_file_limit", F.lit(False))) if "hit_file_limit" in files.columns else F.lit(False)
    out = files.groupBy("target", "version").agg(*map(count, ("ok", "large", "binary", "unreadable")), limit.alias("hit_file_limit"))
    return out.withColumn("exit_code", F.when(F.col("n_ok") == 0, 4))


def coverage_of(files: DataFrame, targets: DataFrame) -> DataFrame:
    """scan_coverage() of the files that were read or tried, with a row of zeros and exit code 4 for each target that has none."""
    counted = scan_coverage(files)
    zeros = {c: F.coalesce(c, F.lit(False) if c == "hit_file_limit" else F.lit(0)) for c in counted.columns if c.startswith("n_") or c == "hit_file_limit"}
    out = targets.select("target", "version").distinct().join(counted, ["target", "version"], "left").withColumns(zeros)
    return out.withColumn("exit_code", F.when(F.col("n_ok") == 0, 4))


def coverage_limitations(coverage: DataFrame) -> DataFrame:
    """(target, version, at, limitation): what the coverage of a target says about what was not looked at, in order."""
    said = lambda when, at, text: F.when(when, F.struct(F.lit(at).alias("at"), text.alias("limitation")))
    many = lambda c, text: F.format_string(f"%d {text}", c)
    rows = F.array(
        said(F.col("n_ok") == 0, 0, F.lit("No file could be read: nothing was looked at.")),
        said(F.col("n_large") > 0, 1, many("n_large", "file(s) were too large to be read.")),
        said(F.col("n_binary") > 0, 2, many("n_binary", "file(s) are binary and were not read.")),
        said(F.col("n_unreadable") > 0, 3, many("n_unreadable", "file(s) could not be opened.")),
        said(F.col("hit_file_limit"), 4, F.lit("There are more files than the limit; the rest was not read.")),
    )
    return coverage.select("target", "version", F.explode(F.array_compact(rows)).alias("l")).select("target", "version", "l.*")


def unanalyzed_findings(files: DataFrame) -> DataFrame:
    """Source files that were not read, as findings of severity HIGH with each file as its evidence, and reached file limits."""
    from tidewatch.operators.findings import evidence, finding

    kind = F.when(F.col("status") == "large", "source.unanalyzed_too_large").otherwise("source.unanalyzed_unreadable")
    rows = files.where((F.col("status") != "ok") & t.file_extension(F.col("path")).isin(*t.SOURCE_EXTENSIONS)).withColumn("rule_id", kind)
    grouped = rows.groupBy("target", "version", "rule_id").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    out = grouped.select("target", "version", *finding(F.col("rule_id"), "SOURCE_CODE", F.lit("HIGH"), F.lit("HIGH"), F.lit("Source files that were not analysed"), F.transform("paths", lambda p: evidence(path=p))))
    if "hit_file_limit" not in files.columns:
        return out
    full = files.where("hit_file_limit").select("target", "version").distinct()
    return union_all(out, full.select("target", "version", *finding(F.lit("source.file_limit_reached"), "SOURCE_CODE", F.lit("HIGH"), F.lit("HIGH"), F.lit("More files than were analysed"), F.array())))
