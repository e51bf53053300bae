"""Outputs: reports, SARIF logs, summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import enums
from tidewatch.functions.text import fingerprint, markdown_escape, path_uri
from tidewatch.operators.findings import rule_index, sets_headline, sort_findings

TOOL = "tidewatch"


def reports(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(target, version, overall, ..., findings): each target's findings in their order."""
    item = F.struct("place", F.struct("rule_id", "area", "severity", "confidence", "title", "evidence").alias("f"))
    each = sort_findings(findings).groupBy("target", "version").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["f"]).alias("findings"))
    return verdicts.join(each, ["target", "version"], "left").withColumn("schema_version", F.lit("1.0"))


def write_reports(findings: DataFrame, verdicts: DataFrame, path: str, kind: str = "json") -> None:
    """One row a target, in folders by overall; null fields are left out of JSON."""
    reports(findings, verdicts).write.partitionBy("overall").format(kind).mode("overwrite").save(path)


def sarif_results(findings: DataFrame, prefix: str = "") -> DataFrame:
    """Findings as SARIF results: level, location of the first evidence with a path, related ones, fingerprint."""
    rows = rule_index(findings).withColumn("head", sets_headline(F.col("evidence")))
    where = F.filter("evidence", lambda e: F.coalesce(e["path"], F.lit("")) != "")

    def location(e):
        snippet = F.when(e["snippet"].isNotNull(), F.struct(e["snippet"].alias("text")))
        region = F.when(e["line"] > 0, F.struct(e["line"].alias("startLine"), snippet.alias("snippet")))
        physical = F.struct(F.struct(path_uri(e["path"], prefix).alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), region.alias("region"))
        return F.struct(physical.alias("physicalLocation"), F.when(e["detail"].isNotNull(), F.struct(e["detail"].alias("text"))).alias("message"))

    first = F.get(where, F.lit(0))
    uri = F.when(F.size(where) > 0, path_uri(first["path"], prefix))
    # The text counts toward the fingerprint only where a line goes with it.
    mark = fingerprint(F.col("rule_id"), uri, F.when(first["line"] > 0, first["snippet"]))
    return rows.withColumns({
        "level": F.when(F.col("head"), enums.sarif_level(F.col("severity"))).otherwise("note"),
        "locations": F.transform(where, location), "uri": uri, "fingerprint": mark,
    })


def sarif_logs(findings: DataFrame, prefix: str = "", limitations: DataFrame | None = None) -> DataFrame:
    """(target, version, log): one SARIF 2.1.0 log a target; rules are declared once, by first appearance.

    limitations (target, version, at, limitation) become notifications of the tool's run, which then counts as not wholly
    successful; targets without findings get a log for them, too.
    """
    rows = sarif_results(findings, prefix)
    rule = F.struct(
        F.col("rule_id").alias("id"), F.replace("rule_id", F.lit("."), F.lit("_")).alias("name"), F.struct(F.col("title").alias("text")).alias("shortDescription"), F.struct(enums.sarif_level(F.col("severity")).alias("level")).alias("defaultConfiguration"),
        F.struct(enums.precision(F.col("confidence")).alias("precision"), enums.security_severity(F.col("severity")).alias("security-severity")).alias("properties"),
    )
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), "level", F.struct(F.col("title").alias("text")).alias("message"), F.slice("locations", 1, 1).alias("locations"),
        F.transform(F.when(F.size("locations") > 1, F.slice("locations", F.lit(2), F.size("locations"))), lambda x, i: x.withField("id", i + 1)).alias("relatedLocations"),
        F.struct(F.col("fingerprint").alias("finding/v1")).alias("partialFingerprints"), F.struct("severity", "confidence", "area", F.col("head").alias("sets_verdict")).alias("properties"),
    )
    w = Window.partitionBy("target", "version", "rule_index").orderBy("place")
    rows = rows.withColumn("new", F.row_number().over(w) == 1)
    logs = rows.groupBy("target", "version").agg(
        F.array_sort(F.collect_list(F.struct("place", result.alias("r")))).alias("results"),
        F.array_sort(F.collect_list(F.when(F.col("new"), F.struct("rule_index", rule.alias("r"))))).alias("rules"),
    )
    if limitations is not None:
        note = F.struct("at", F.struct(F.struct(F.col("limitation").alias("text")).alias("message"), F.lit("warning").alias("level")).alias("n"))
        notes = limitations.groupBy("target", "version").agg(F.transform(F.array_sort(F.collect_list(note)), lambda x: x["n"]).alias("notes"))
        logs = logs.join(notes, ["target", "version"], "full")
        run = F.when(F.col("notes").isNotNull(), F.array(F.struct(F.lit(False).alias("executionSuccessful"), F.col("notes").alias("toolExecutionNotifications"))))
    else:
        run = F.lit(None).cast("array<string>")
    whole = lambda c: F.coalesce(F.col(c), F.array().cast(logs.schema[c].dataType))
    body = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(F.struct(F.lit(TOOL).alias("name"), F.transform(whole("rules"), lambda x: x["r"]).alias("rules")).alias("driver")).alias("tool"), run.alias("invocations"), F.transform(whole("results"), lambda x: x["r"]).alias("results"))).alias("runs"))
    return logs.select("target", "version", F.to_json(body).alias("log"))


def write_sarif(findings: DataFrame, path: str, prefix: str = "", limitations: DataFrame | None = None) -> None:
    """One log a line; null fields are left out."""
    sarif_logs(findings, prefix, limitations).select(F.col("log").alias("value")).write.mode("overwrite").text(path)


def summary_rows(findings: DataFrame, most: int = 25) -> DataFrame:
    """Markdown-safe rows of each target, its worst first, with the number that is not shown."""
    first = F.get(F.filter("evidence", lambda e: e["path"].isNotNull()), F.lit(0))
    place = F.concat(first["path"], F.when(first["line"].isNotNull(), F.concat(F.lit(":"), first["line"].cast("string"))).otherwise(""))
    rows = sort_findings(findings).withColumn("n", F.count("*").over(Window.partitionBy("target", "version"))).where(F.col("place") <= most)
    return rows.select("target", "version", "place", "severity", "confidence", markdown_escape(F.col("rule_id")).alias("rule"), markdown_escape(F.coalesce(place, F.lit("-"))).alias("first_evidence"), sets_headline(F.col("evidence")).alias("sets_verdict"), F.greatest(F.lit(0), F.col("n") - most).alias("n_hidden"))
