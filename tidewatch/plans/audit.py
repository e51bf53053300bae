"""Whole workloads, composed of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.advice import with_advice
from tidewatch.functions.shared import saved
from tidewatch.functions.text import SOURCE_EXTENSIONS, file_extension, is_scannable, normal_text, snippet, walk_key
from tidewatch.functions.unions import union_all
from tidewatch.operators import annotations, dependencies, diff, file_helpers, files, findings, flows, injection, install, matches, network, provider
from tidewatch.operators.findings import evidence


def source_findings(lines: DataFrame, with_context: bool = True, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches with their context, findings of the rules)."""
    found = matches.match_rules(lines)
    if with_context:
        found = matches.match_context(saved(found, "matches"), lines, None if files is None else file_helpers.prose_in_files(files))
    else:
        found = found.withColumn("context", F.lit(None).cast("string"))
    # Read by every finding, capability and flow below: matched once.
    found = saved(found, "matches")
    return found, findings.matches_to_findings(found)


def audit_findings(lines: DataFrame, purpose: Column | None = None, with_context: bool = True, files: DataFrame | None = None) -> DataFrame:
    """Findings of every analyser that reads lines. With files (their normal_text) what needs whole files is read off these."""
    return _line_findings(lines, purpose, with_context, files)[0]


def _line_findings(lines: DataFrame, purpose: Column | None, with_context: bool = True, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, matches with their context, flows with destination and scope)."""
    found, rules = source_findings(lines, with_context, files)
    paired = flows.with_destination(saved(flows.pair_flows(found), "flows"), lines)
    docs = lines.where(file_extension(F.col("path")).isin(".md", ".txt", ".rst"))
    if files is None:
        paired = provider.scope_provider_flows(paired, lines, docs)
        texts, claims = injection.tool_texts(lines), annotations.tool_claims(lines)
    else:
        profiles = saved(file_helpers.provider_profiles_in_files(files), "profiles")
        paired = provider.scope_provider_flows(paired, None, docs, profiles)
        texts, claims = file_helpers.tool_texts_in_files(files), file_helpers.tool_claims_in_files(files)
    paired = saved(paired, "scoped")
    every = findings.union_findings(
        rules, findings.combination_findings(found), flows.dataflow_findings(paired), network.network_findings(network.extract_endpoints(lines, purpose)),
        injection.detect_tool_poisoning(None, texts), injection.detect_doc_injection(lines), annotations.contradicted_annotations(claims, found), install.detect_install_risk(lines),
    )
    return every, found, paired


def _opened(trees: DataFrame, most_files: int | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files worth reading with their status, manifests and lockfiles as text, text files, their lines, targets).

    Lockfiles are noted for the dependencies wherever they lie; their lines are looked at, and they count as read, only
    where the file is worth reading anyway. The trees are read twice: for what is known of each file, and for the texts.
    """
    every = files.classify_readability(trees)
    known = files.worth_reading(every)
    if most_files is not None:
        known = files.readable_cap(known, most_files)
    text = F.when(F.col("status") == "ok", F.make_valid_utf8(F.col("content").cast("string"))).alias("text")
    readable = saved(known.where("status = 'ok'").select("target", "version", "path", normal_text(text).alias("text")), "texts")
    locks = files.noted_lockfiles(every).select("target", "version", "path").distinct()
    locks = every.join(locks, ["target", "version", "path"], "left_semi").where(~is_scannable(F.col("path"))).select("target", "version", "path", text)
    known = saved(known.drop("content"), "files")
    return known, union_all(readable, locks), readable, saved(files.explode_lines(readable), "lines"), saved(trees.select("target", "version").distinct(), "targets")


def audit_targets(trees: DataFrame, purpose: Column | None = None, most_files: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, verdicts, coverage) of source trees (target, version, path, size, content).

    With most_files only that many readable files of a target are read, in walk order, and one that has more says so.
    """
    return _audited(*_opened(trees, most_files), purpose)[:3]


def _audited(known: DataFrame, manifests: DataFrame, readable: DataFrame, lines: DataFrame, targets: DataFrame, purpose: Column | None) -> tuple[DataFrame, ...]:
    """(findings, verdicts, coverage, dependencies, matches with their context, flows)."""
    deps = saved(dependencies.analyze_dependencies(manifests), "dependencies")
    own, found, paired = _line_findings(lines, purpose, True, readable)
    every = saved(findings.union_findings(own, dependencies.dependency_findings(deps), files.unanalyzed_findings(known)), "findings")
    coverage = files.coverage_of(known, targets)
    verdicts = findings.overall_verdict(every, targets).join(coverage.select("target", "version", F.col("exit_code").alias("unread")), ["target", "version"], "left")
    return every, verdicts.withColumn("exit_code", F.coalesce("unread", "exit_code")).drop("unread"), coverage, deps, found, paired


#: Areas that an audit of a source tree looks at; the others need metadata.
SOURCE_AREAS = ("SOURCE_CODE", "CAPABILITIES", "INSTALLATION", "DEPENDENCIES", "NETWORK", "PROMPT_INJECTION")


def target_reports(trees: DataFrame, purpose: Column | None = None, most_files: int | None = None, metadata: DataFrame | None = None, checked: DataFrame | None = None, known_as: DataFrame | None = None) -> DataFrame:
    """One whole report a target and version: verdict, findings with advice, areas, capabilities, credentials, endpoints, dataflows, dependencies, coverage, limitations, notes.

    metadata are findings from repository or registry metadata (version null: of every version), checked what their
    analysers say of their areas (target, version, area, status, summary). Lists are ordered; what was not looked at
    is NOT_CHECKED, a dependency area without a manifest NOT_APPLICABLE. known_as has the source_url of a target and
    further columns about it, one row a target, which go to notes.repository; without it both are null. dataflows are the
    first 12 of a target and n_flows_hidden says how many more there are; findings come from all of them. notes names
    the first 20 files each that were too large, binary or not to be opened.
    """
    keys = ["target", "version"]
    known, manifests, readable, lines, seen = _opened(trees, most_files)
    every, _, coverage, deps, found, paired = _audited(known, manifests, readable, lines, seen, purpose)
    coverage = saved(coverage, "coverage")
    targets = coverage.select(*keys)
    if metadata is not None:
        own = targets.select("target", F.col("version").alias("v"))
        every = findings.union_findings(every, metadata.join(own, "target").where("version is null or version = v").withColumn("version", F.col("v")).drop("v"))
    verdicts = findings.overall_verdict(every, targets)
    looked = coverage.select(*keys, F.explode(F.array(*map(F.lit, SOURCE_AREAS))).alias("area"), F.when(F.col("n_ok") > 0, "VERIFIED").otherwise("UNAVAILABLE").alias("status"), F.lit(None).cast("string").alias("summary"))
    manifest = deps.select(*keys, F.col("status").alias("manifest"))
    looked = looked.join(manifest, keys, "left").withColumn("status", F.when(F.col("area") == "DEPENDENCIES", F.coalesce("manifest", "status")).otherwise(F.col("status"))).drop("manifest")
    areas = findings.area_report(every, looked if checked is None else findings.union_findings(looked, checked))

    def listed(rows: DataFrame, name: str, order: list, *columns: str) -> DataFrame:
        item = F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("x"))
        return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["x"]).alias(name))

    sorted_ = with_advice(findings.sort_findings(every))
    said = files.coverage_limitations(coverage)
    out = verdicts.withColumn("schema_version", F.lit("1.0")).join(coverage.drop("exit_code"), keys, "left").withColumn("exit_code", F.when(F.col("n_ok") == 0, 4).otherwise(F.col("exit_code")))
    parts = (
        listed(areas, "areas", ["place"], "area", "status", "severity", "n_findings", "summary"),
        listed(sorted_, "findings", ["place"], "rule_id", "area", "severity", "confidence", "title", "explanation", "remediation", "evidence", "n_further"),
        listed(findings.matches_to_capabilities(found), "capabilities", ["capability"], "capability", "description", "n", "evidence"),
        listed(network.extract_credentials(lines), "credentials", ["name"], "name", "required", "blast_radius", "path", "line"),
        listed(network.sort_endpoints(network.extract_endpoints(lines, purpose)), "endpoints", ["place"], "host", "scheme", "classification", "reason", "n", "path", "line"),
        listed(flow_rows(paired), "dataflows", ["place"], "source", "sink", "destination", "confidence", "provider_scope", "evidence"),
        flows.flow_cap(paired).groupBy(*keys).agg(F.max("n_hidden").cast("int").alias("n_flows_hidden")),
        report_notes(known, targets, known_as),
        listed(said, "limitations", ["at"], "limitation"),
        dependencies.dependency_summary(deps).select(*keys, F.struct("ecosystem", "status", "n_direct", "n_floating", "n_remote", "n_hooks", "lockfile", "n_locked", "replaced").alias("dependencies")),
    )
    for part in parts:
        out = out.join(part, keys, "left")
    empty = {f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) for f in out.schema.fields if f.dataType.typeName() == "array"}
    return out.withColumns(empty)


def flow_rows(paired: DataFrame) -> DataFrame:
    """The capped flows of each target as a report shows them: both lines as evidence, in order."""
    capped = flows.flow_cap(paired)
    line = lambda side: evidence(F.col("path"), F.col(f"{side}_line"), snippet(F.col(f"{side}_text")), F.lit(side))
    return capped.select("target", "version", F.col("rn").alias("place"), "source", "sink", "destination", "confidence", "provider_scope", F.array(line("source"), line("sink")).alias("evidence"))


def report_notes(known: DataFrame, targets: DataFrame, known_as: DataFrame | None, most: int = 20) -> DataFrame:
    """(target, version, source_url, notes): files_scanned and the first files of each kind that were not read, and what is known of the target."""
    keys = ["target", "version"]
    w = Window.partitionBy(*keys, "status").orderBy("walk")
    first = known.where("status <> 'ok'").withColumn("walk", walk_key(F.col("path"))).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    named = lambda s, x: F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("rn", x.alias("x"))))), lambda i: i["x"])
    skipped = first.groupBy(*keys).agg(named("large", F.struct("path", "size")).alias("skipped_too_large"), named("binary", F.col("path")).alias("skipped_binary"), named("unreadable", F.col("path")).alias("skipped_unreadable"))
    read = known.groupBy(*keys).agg(F.count_if(F.col("status") == "ok").alias("files_scanned"))
    out = targets.select(*keys).distinct().join(read, keys, "left").join(skipped, keys, "left")
    parts = [F.coalesce("files_scanned", F.lit(0)).alias("files_scanned"), *(F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) for c in ("skipped_too_large", "skipped_binary", "skipped_unreadable"))]
    if known_as is None:
        return out.select(*keys, F.lit(None).cast("string").alias("source_url"), F.struct(*parts).alias("notes"))
    about = known_as.select("target", "source_url", F.struct(*[c for c in known_as.columns if c not in ("target", "source_url")]).alias("repository"))
    return out.join(about, "target", "left").select(*keys, "source_url", F.struct(*parts, "repository").alias("notes"))


def drift(lines: DataFrame, before: str, after: str) -> tuple[DataFrame, DataFrame]:
    """(changes, findings) between two versions of every target; source files only, whatever a match's context."""
    source = lines.where(file_extension(F.col("path")).isin(*SOURCE_EXTENSIONS))
    found = saved(matches.match_rules(source), "matches")
    sets = diff.version_sets(found, network.extract_credentials(source), network.extract_endpoints(source))
    changes = diff.diff_versions(sets, before, after)
    return changes, diff.diff_findings(changes, found, before, after)
