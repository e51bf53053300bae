"""What a version gained over another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.catalogue import ESCALATION
from tidewatch.functions.enums import severity_rank
from tidewatch.functions.text import SOURCE_EXTENSIONS, file_extension
from tidewatch.functions.unions import union_all
from tidewatch.functions.versions import version_key
from tidewatch.operators.findings import evidence, finding, first_evidence

MOST_CHANGED = 60


def version_sets(matches: DataFrame, credentials: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(target, version, kind, item): capabilities, credentials and hosts of each version, once each."""
    rows = matches.where("capability is not null").select("target", "version", F.lit("capability").alias("kind"), F.col("capability").alias("item"))
    named = lambda df, kind, column: df.select("target", "version", F.lit(kind).alias("kind"), F.col(column).alias("item"))
    return union_all(rows, named(credentials, "credential", "name"), named(endpoints, "endpoint", "host")).distinct()


def diff_versions(sets: DataFrame, before: str, after: str) -> DataFrame:
    """(target, kind, item, change): added or removed between two versions, for targets that have both."""
    both = sets.groupBy("target").agg(F.array_sort(F.collect_set("version")).alias("v")).where(F.array_contains("v", before) & F.array_contains("v", after)).select("target")
    rows = sets.where(F.col("version").isin(before, after)).join(both, "target", "left_semi")
    sides = rows.groupBy("target", "kind", "item").agg(F.bool_or(F.col("version") == before).alias("had"), F.bool_or(F.col("version") == after).alias("has"))
    return sides.where("had <> has").select("target", "kind", "item", F.when(F.col("has"), "added").otherwise("removed").alias("change"))


def version_drift(sets: DataFrame, kind: str = "capability") -> DataFrame:
    """(target, version, added, removed): each version against the one before, in the order of their values (functions.versions)."""
    each = sets.where(F.col("kind") == kind).groupBy("target", "version").agg(F.collect_set("item").alias("items"))
    before = F.coalesce(F.lag("items").over(Window.partitionBy("target").orderBy(version_key(F.col("version")), "version")), F.array().cast("array<string>"))
    return each.withColumn("before", before).select("target", "version", F.array_sort(F.array_except("items", "before")).alias("added"), F.array_sort(F.array_except("before", "items")).alias("removed"))


def diff_findings(changes: DataFrame, matches: DataFrame, before: str, after: str) -> DataFrame:
    """Findings for gained capabilities (rated by what they are), credentials (HIGH) and hosts (MEDIUM)."""
    gained = changes.where("change = 'added'")
    rated = F.create_map(*[F.lit(x) for kv in ESCALATION.items() for x in kv])
    proof = first_evidence(matches.where((F.col("version") == after) & F.col("capability").isNotNull()).withColumn("context", F.lit(None).cast("string")), ("target", "version", "capability"), 3)
    caps = gained.where("kind = 'capability'").withColumn("severity", rated[F.col("item")]).where("severity is not null").withColumnRenamed("item", "capability").join(proof, ["target", "capability"])
    out = caps.select("target", F.lit(after).alias("version"), *finding(F.concat(F.lit("diff.capability_added."), "capability"), "SOURCE_CODE", F.col("severity"), F.lit("MEDIUM"), F.concat(F.lit(f"New capability since {before}: "), "capability"), F.col("evidence")))
    for kind, rule, area, severity, title, most in (("credential", "diff.credentials_added", "CAPABILITIES", "HIGH", f"Asks for credentials it did not want in {before}", 1 << 30), ("endpoint", "diff.endpoints_added", "NETWORK", "MEDIUM", f"Contacts hosts it did not contact in {before}", 5)):
        rows = gained.where(F.col("kind") == kind).groupBy("target").agg(F.slice(F.array_sort(F.collect_list("item")), 1, most).alias("items"))
        out = union_all(out, rows.select("target", F.lit(after).alias("version"), *finding(F.lit(rule), area, F.lit(severity), F.lit("MEDIUM"), F.lit(title), F.transform("items", lambda i: evidence(detail=i)))))
    return out


def diff_gate(findings: DataFrame) -> DataFrame:
    """Worst severity of each target's changes, without demotion."""
    return findings.groupBy("target").agg(F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"))


def changed_files_only(files: DataFrame, changed: DataFrame, most: int = MOST_CHANGED) -> DataFrame:
    """files at the first changed source paths of each target; truncated tells where there were more.

    changed is (target, path, seq), seq the order in which the changes were listed.
    """
    source = changed.where(file_extension(F.col("path")).isin(*SOURCE_EXTENSIONS))
    first = source.withColumn("rn", F.row_number().over(Window.partitionBy("target").orderBy("seq"))).where(F.col("rn") <= most)
    counts = source.groupBy("target").agg((F.count("*") > most).alias("truncated"))
    return files.join(first.join(counts, "target").select("target", "path", "truncated"), ["target", "path"])
