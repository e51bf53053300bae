"""Findings: their shape, grouping, headline algebra, order, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import enums, text
from tidewatch.functions.text import snippet, walk_key
from tidewatch.functions.unions import union_all

EVIDENCE = "struct<path:string,line:int,snippet:string,detail:string,context:string>"
COLUMNS = ("target", "version", "rule_id", "area", "severity", "confidence", "title", "evidence", "n_further")


def evidence(path: Column | None = None, line: Column | None = None, text_: Column | None = None, detail: Column | None = None, context: Column | None = None) -> Column:
    parts = {"path": path, "line": line, "snippet": text_, "detail": detail, "context": context}
    return F.struct(*[(F.lit(None) if c is None else c).cast("int" if n == "line" else "string").alias(n) for n, c in parts.items()])


def finding(rule_id: Column, area: str, severity: Column, confidence: Column, title: Column, proof: Column, further: Column | None = None) -> list[Column]:
    return [rule_id.alias("rule_id"), F.lit(area).alias("area"), severity.alias("severity"), confidence.alias("confidence"), title.alias("title"), proof.cast(f"array<{EVIDENCE}>").alias("evidence"), F.coalesce(further if further is not None else F.lit(0), F.lit(0)).cast("bigint").alias("n_further")]


def first_evidence(matches: DataFrame, keys: tuple[str, ...], most: int, limit: int = 200) -> DataFrame:
    """keys, n and evidence, the first rows of each group in match order: files as walked, then lines, then rules.

    Only the first rows of a group are sorted and gathered, however large it is: they are picked in every task before
    rows travel, and counts are partial sums.
    """
    w = Window.partitionBy(*keys).orderBy("walk", "line", "rule_no")
    rows = matches.withColumn("walk", walk_key(F.col("path"))).withColumn("rn", F.row_number().over(w))
    counts = matches.groupBy(*keys).agg(F.count("*").alias("n"))
    proof = F.struct("rn", evidence(F.col("path"), F.col("line"), snippet(F.col("text"), limit), None, F.col("context")).alias("e"), F.col("title").alias("title"))
    first = rows.where(F.col("rn") <= most).groupBy(*keys).agg(F.array_sort(F.collect_list(proof)).alias("first")).join(counts, list(keys))
    return first.select(*keys, "n", F.transform("first", lambda x: x["e"]).alias("evidence"), F.get("first", F.lit(0))["title"].alias("first_title"))


def matches_to_findings(matches: DataFrame) -> DataFrame:
    """One finding a rule that is not informational, with five pieces of evidence and the number of further ones."""
    keys = ("target", "version", "rule_id", "severity", "confidence", "title_key")
    rows = matches.where("not informational").withColumn("title_key", F.col("title"))
    got = first_evidence(rows, keys, 5)
    return got.select("target", "version", *finding(F.col("rule_id"), "SOURCE_CODE", F.col("severity"), F.col("confidence"), F.col("title_key"), F.col("evidence"), F.col("n") - F.size("evidence")))


def matches_to_capabilities(matches: DataFrame) -> DataFrame:
    """(target, version, capability, description, n, evidence): three pieces, described by the first match's rule."""
    got = first_evidence(matches.where("capability is not null"), ("target", "version", "capability"), 3)
    return got.select("target", "version", "capability", F.col("first_title").alias("description"), "n", "evidence")


def combination_findings(matches: DataFrame) -> DataFrame:
    """Pairs that are ordinary alone: decoding with evaluation, package installs with a shell."""
    sets = matches.where("capability is not null").groupBy("target", "version").agg(F.collect_set("capability").alias("caps"))
    has = lambda *c: F.arrays_overlap("caps", F.array(*map(F.lit, c)))
    proof = first_evidence(matches.where(F.col("capability").isin("encoding.base64", "code.eval", "package.install")), ("target", "version", "capability"), 2)
    two = proof.groupBy("target", "version").agg(F.map_from_entries(F.collect_list(F.struct("capability", "evidence"))).alias("proof"))
    rows = sets.join(two, ["target", "version"])
    got = lambda c: F.col("proof")[c]
    decode = rows.where(has("encoding.base64") & has("code.eval")).select("target", "version", *finding(F.lit("combo.decode_then_execute"), "SOURCE_CODE", F.lit("CRITICAL"), F.lit("MEDIUM"), F.lit("Has what it takes to unpack hidden code and run it"), F.concat(got("encoding.base64"), got("code.eval"))))
    install = rows.where(has("package.install") & has("shell.execute", "process.spawn")).select("target", "version", *finding(F.lit("combo.runtime_package_install"), "INSTALLATION", F.lit("HIGH"), F.lit("MEDIUM"), F.lit("Runs commands and adds packages while in use"), got("package.install")))
    return union_all(decode, install)


def union_findings(*frames: DataFrame) -> DataFrame:
    """Findings of several analysers as one table."""
    return union_all(*frames)


def quiet(e: Column) -> Column:
    """Evidence in prose or in a list of what is refused."""
    return F.coalesce(e["context"].isin("prose", "exclusion"), F.lit(False))


def sets_headline(proof: Column) -> Column:
    """No evidence at all, or one piece that is shipped code and neither prose nor a refusal."""
    return (F.size(proof) == 0) | F.exists(proof, lambda e: ~quiet(e) & text.is_shipped(e["path"]))


def is_outside_shipped(proof: Column) -> Column:
    return (F.size(proof) > 0) & F.forall(proof, lambda e: ~text.is_shipped(e["path"]))


def is_defensive(proof: Column) -> Column:
    return (F.size(proof) > 0) & F.forall(proof, quiet)


def sort_key() -> list[Column]:
    """Severity and confidence from the top, then rule and title."""
    return [F.desc(enums.severity_rank(F.col("severity"))), F.desc(enums.confidence_rank(F.col("confidence"))), F.col("rule_id"), F.col("title")]


def sort_findings(findings: DataFrame) -> DataFrame:
    """findings with place, each target's own order."""
    return findings.withColumn("place", F.row_number().over(Window.partitionBy("target", "version").orderBy(*sort_key())))


def area_severities(findings: DataFrame) -> DataFrame:
    """Worst severity of each area at full weight, and a note where nothing in it sets the headline."""
    head = sets_headline(F.col("evidence"))
    out = findings.groupBy("target", "version", "area").agg(F.max(enums.severity_rank(F.col("severity"))).alias("rank"), F.count("*").alias("n_findings"), F.bool_or(head).alias("in_verdict"))
    return out.select("target", "version", "area", enums.severity_of(F.col("rank")).alias("severity"), "n_findings", F.when(~F.col("in_verdict"), "not in the verdict").alias("note"))


def overall_verdict(findings: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """The headline of each target: worst of what sets it, findings of low confidence one notch lower.

    targets (target, version) adds those without any finding, as NOT_FLAGGED.
    """
    weight = F.when(sets_headline(F.col("evidence")), enums.demoted_rank(F.col("severity"), F.col("confidence")))
    out = findings.groupBy("target", "version").agg(F.coalesce(F.max(weight), F.lit(0)).alias("rank"), F.count("*").alias("n_findings"))
    if targets is not None:
        out = targets.select("target", "version").distinct().join(out, ["target", "version"], "left").fillna(0, ["rank", "n_findings"])
    overall = enums.severity_of(F.col("rank"))
    return out.select("target", "version", overall.alias("overall"), enums.recommendation(overall).alias("recommendation"), enums.exit_code(overall).alias("exit_code"), "n_findings")


def gate(verdicts: DataFrame, fail_on: str) -> DataFrame:
    """Targets that reach the threshold; 4, not looked at, always does; low and medium share one."""
    level = {"low": 1, "medium": 1, "high": 2, "critical": 3}[fail_on]
    return verdicts.where(F.col("exit_code") >= level)


def area_report(findings: DataFrame, checked: DataFrame) -> DataFrame:
    """(target, version, area, place, status, severity, n_findings, summary): every area of every target, in their order.

    checked (target, version, area, status, summary) says which areas an analyser looked at and what it has to say; areas
    that it lacks are NOT_CHECKED. A finding makes its area VERIFIED: something was seen there.
    """
    keys = ["target", "version"]
    areas = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(a).alias("area")) for i, a in enumerate(enums.AREAS)])
    every = union_all(checked.select(*keys), findings.select(*keys)).distinct().select(*keys, F.explode(areas).alias("a")).select(*keys, "a.*")
    rows = every.join(checked.select(*keys, "area", "status", "summary"), [*keys, "area"], "left").join(area_severities(findings), [*keys, "area"], "left")
    status = F.when(F.col("n_findings") > 0, "VERIFIED").otherwise(F.coalesce("status", F.lit("NOT_CHECKED")))
    words = F.concat_ws(" ", "summary", F.when(F.col("note").isNotNull(), F.concat(F.lit("("), "note", F.lit(")"))))
    return rows.select(*keys, "area", "place", status.alias("status"), F.coalesce("severity", F.lit("NOT_FLAGGED")).alias("severity"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"), F.trim(words).alias("summary"))


def limitations(rows: DataFrame) -> DataFrame:
    """(target, limitations): distinct in order of at; equal but for case, ends and a last dot counts as equal."""
    key = F.regexp_replace(F.lower(text.strip(F.col("limitation"))), r"\.+$", "")
    first = rows.groupBy("target", key.alias("key")).agg(F.min_by(F.struct("at", "limitation"), "at").alias("x"))
    return first.groupBy("target").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["limitation"]).alias("limitations"))


def fleet_summary(findings: DataFrame) -> DataFrame:
    """Counts by target, place (inside or outside shipped code) and severity with subtotals; null is a total."""
    rows = findings.withColumn("place", F.when(is_outside_shipped(F.col("evidence")), "outside").otherwise("shipped"))
    return rows.rollup("target", "place", "severity").agg(F.count("*").alias("n"))


def worst_targets(verdicts: DataFrame, most: int) -> DataFrame:
    return verdicts.orderBy(F.desc(enums.severity_rank(F.col("overall"))), "target", "version").limit(most)


def fleet_totals(findings: DataFrame) -> DataFrame:
    """(place, severity, n, share) over all targets: by place and severity, by place, and in all (null is a total).

    share is that of all findings; the one of place outside without a severity is the share outside shipped code. Without findings no row.
    """
    rows = findings.select(F.when(is_outside_shipped(F.col("evidence")), "outside").otherwise("shipped").alias("place"), "severity")
    sets = rows.groupingSets([["place", "severity"], ["place"], []], "place", "severity").agg(F.count("*").alias("n"))
    return sets.withColumn("share", F.col("n") / F.max("n").over(Window.partitionBy(F.lit(0))))  # fifteen rows at most


def verdict_distribution(verdicts: DataFrame) -> DataFrame:
    """(overall, n_targets, share): how many targets and versions have each verdict; those without one are NOT_FLAGGED."""
    counts = verdicts.groupBy(F.coalesce("overall", F.lit("NOT_FLAGGED")).alias("overall")).agg(F.count("*").alias("n_targets"))
    return counts.withColumn("share", F.col("n_targets") / F.sum("n_targets").over(Window.partitionBy(F.lit(0))))  # six rows at most


def shipped_alarms(findings: DataFrame, paths: int = 2) -> DataFrame:
    """Findings of severity CRITICAL or HIGH in shipped code (or without a path), with their first paths."""
    rows = findings.where(F.col("severity").isin("CRITICAL", "HIGH") & ~is_outside_shipped(F.col("evidence")))
    named = F.filter(F.transform(F.coalesce("evidence", F.array().cast(findings.schema["evidence"].dataType)), lambda e: e["path"]), lambda p: p.isNotNull())
    return rows.select("target", "version", "rule_id", "severity", "confidence", "title", F.slice(named, 1, paths).alias("paths"))


def worst_drilldown(verdicts: DataFrame, findings: DataFrame, most: int, alarms: int = 20) -> DataFrame:
    """worst_targets() with n_alarms and alarms: their worst shipped_alarms(), so many at most, the most severe first."""
    keys = ["target", "version"]
    worst = worst_targets(verdicts, most).select(*keys, "overall")
    own = shipped_alarms(findings).join(worst, keys, "left_semi")
    rank = Window.partitionBy(*keys).orderBy(F.desc(enums.severity_rank(F.col("severity"))), F.desc(enums.confidence_rank(F.col("confidence"))), "rule_id", "title")
    item = F.struct("rn", F.struct("rule_id", "severity", "confidence", "title", "paths").alias("x"))
    first = own.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= alarms).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["x"]).alias("alarms"))
    counts = own.groupBy(*keys).agg(F.count("*").alias("n_alarms"))
    out = worst.join(counts, keys, "left").join(first, keys, "left")
    return out.withColumns({"n_alarms": F.coalesce("n_alarms", F.lit(0)), "alarms": F.coalesce("alarms", F.array().cast(out.schema["alarms"].dataType))})


def rule_index(findings: DataFrame) -> DataFrame:
    """findings with rule_index, the order in which a target's rules first appear."""
    ordered = sort_findings(findings)
    first = ordered.groupBy("target", "version", "rule_id").agg(F.min("place").alias("first"))
    index = first.withColumn("rule_index", F.row_number().over(Window.partitionBy("target", "version").orderBy("first")) - 1).drop("first")
    return ordered.join(index, ["target", "version", "rule_id"])
