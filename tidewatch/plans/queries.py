"""The registered queries of the audit library, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import enums, hosts
from tidewatch.functions import text as t
from tidewatch.functions.catalogue import CATALOGUE, ESCALATION, EXFIL_WORTHY, OUTBOUND
from tidewatch.functions.shared import saved
from tidewatch.operators import dependencies, diff, findings, flows, injection, install, matches, metadata, network
from tidewatch.plans import audit, views
from tidewatch.sources import writers
from tidewatch.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "1998-09-01 00:00:00"

# --- SQL building blocks (DuckDB) --------------------------------------------------------------------------


def _plain(pattern: str) -> str:
    """A rule's pattern without lookbehind, which this SQL's engine lacks; the guard consumes a sign instead."""
    return pattern.replace(r"(?<![\w$.])", r"(?:^|[^\w$.])").replace(r"(?<![\w.])(?<!&)(?<!&\s)", r"(?:^|[^\w.&])").replace(r"(?<![\w.])", r"(?:^|[^\w.])")


def _q(x) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


_RULES = ", ".join("(" + ", ".join(_q(x) for x in (i, r.rule_id, _plain(r.pattern), "," + ",".join(r.extensions) + "," if r.extensions else "", r.title, r.severity, r.confidence, r.capability, r.role, r.informational)) + ")" for i, r in enumerate(CATALOGUE))
_EXT = "lower(regexp_extract(path, '[^./][^/]*?(\\.[^./]*)$', 1))"
_LINES = f"lines AS ({views.code_lines_sql('events')})"
_MATCHES = f"""{_LINES},
rules(rule_no, rule_id, pattern, exts, title, severity, confidence, capability, role, informational) AS (VALUES {_RULES}),
kinds AS (SELECT DISTINCT text, {_EXT} AS ext FROM lines),
hits AS (SELECT k.text, k.ext, r.* FROM kinds k JOIN rules r ON (r.exts = '' OR contains(r.exts, ',' || k.ext || ',')) AND regexp_matches(k.text, r.pattern)),
m AS (SELECT l.target, l.version, l.path, l.line, l.text, h.* EXCLUDE (text, ext, pattern, exts), CASE WHEN contains(l.path, '/') THEN 1 ELSE 0 END AS deep
  FROM lines l JOIN hits h ON l.text = h.text AND {_EXT.replace("path", "l.path")} = h.ext)"""
_SEV = "list_position(['NOT_FLAGGED', 'INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], {}) - 1"
_SEVS = "['NOT_FLAGGED', 'INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL']"
_SHIPPED = "path <> 'tests/test_x.py'"
_SNIP = "CASE WHEN length(trim(text)) > 200 THEN substr(trim(text), 1, 199) || '…' ELSE trim(text) END"
_URLS = r"""u AS (SELECT target, version, path, line, text, regexp_extract(x, '(https?)://([A-Za-z0-9._~-]+)(?::(\d+))?', 1) AS scheme, regexp_replace(lower(regexp_extract(x, '(https?)://([A-Za-z0-9._~-]+)(?::(\d+))?', 2)), '\.+$', '') AS host
  FROM (SELECT *, unnest(regexp_extract_all(text, '(https?)://([A-Za-z0-9._~-]+)(?::(\d+))?')) AS x FROM lines))"""
_LIST = lambda xs: ", ".join(_q(x) for x in xs)
_NAME = f"CASE WHEN len(p) >= 3 AND p[-2] IN ({_LIST(hosts.SECOND_LEVEL)}) THEN p[-3] WHEN len(p) >= 2 THEN p[-2] ELSE host END"
_CLASS = f"""CASE WHEN host IN ({_LIST(hosts.SUSPICIOUS)}) THEN 'SUSPICIOUS' WHEN host IN ({_LIST(hosts.TELEMETRY)}) THEN 'UNEXPLAINED' WHEN regexp_full_match(host, '\\d{{1,3}}(\\.\\d{{1,3}}){{3}}') THEN 'SUSPICIOUS'
  WHEN host IN ({_LIST(hosts.INFRASTRUCTURE)}) THEN 'INFRASTRUCTURE' WHEN {_NAME} IN ('example', 'service') THEN 'EXPECTED' ELSE 'UNEXPLAINED' END"""
_ENDPOINTS = _URLS + f""",
f AS (SELECT *, row_number() OVER (PARTITION BY target, version, host ORDER BY CASE WHEN contains(path, '/') THEN 1 ELSE 0 END, path, line) AS rn, count(*) OVER (PARTITION BY target, version, host) AS n FROM u WHERE host <> '' AND (contains(host, '.') OR host = 'localhost')),
ep AS (SELECT target, version, host, scheme, {_CLASS} AS classification, scheme = 'http' AND host NOT IN ('localhost', '127.0.0.1', '0.0.0.0') AS plain_http, n, path, line FROM (SELECT *, string_split(host, '.') AS p FROM f WHERE rn = 1))"""
_REPOS = "repos AS (" + views.repos_sql("customer", "orders", "lineitem", "strftime({}, '%Y-%m-%dT%H:%M:%SZ')") + ")"
_REG = "reg AS (" + views.registry_sql("supplier", "part") + ")"
_AGE = lambda c: f"CAST(floor((epoch(TIMESTAMP '{NOW}') - epoch(CAST(substr({c}, 1, 19) AS TIMESTAMP))) / 86400) AS BIGINT)"
_NORM = lambda c: f"CASE WHEN regexp_matches({c}, '(?:https?://|git@)([^/:]+)[/:]([^/]+)/([^/]+)$') THEN lower(regexp_replace({c}, '^.*(?:https?://|git@)([^/:]+)[/:]([^/]+)/([^/]+)$', '\\1/\\2/\\3')) END"
_CLEAN = lambda c: f"regexp_replace(regexp_replace(regexp_replace({c}, '/+$', ''), '^git\\+', ''), '\\.git$', '')"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.match_rules(views.code_lines(spark, sf_dir)).withColumn("context", F.lit(None).cast("string"))


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches as a written table, for what reads them more than once."""
    return saved(_found(spark, sf_dir), "matches")


def _shown(df: DataFrame) -> DataFrame:
    """Findings with evidence as one string, for comparison."""
    proof = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["path"], e["line"].cast("string"), e["snippet"], e["detail"])), " | ")
    return df.withColumn("evidence", proof).withColumn("version", F.coalesce("version", F.lit("")))


# --- matches, findings, verdicts ---------------------------------------------------------------------------


@query("match_rules", f"WITH {_MATCHES} SELECT target, version, path, line, rule_id, capability, role FROM m")
def _(spark, sf_dir):
    return _found(spark, sf_dir).select("target", "version", "path", "line", "rule_id", "capability", "role")


_FINDINGS = f"""{_MATCHES},
r AS (SELECT *, row_number() OVER (PARTITION BY target, version, rule_id ORDER BY deep, path, line) AS rn FROM m WHERE NOT informational),
fd AS (SELECT target, version, rule_id, any_value(severity) AS severity, any_value(confidence) AS confidence, any_value(title) AS title, string_agg(path || ':' || line || ':' || ({_SNIP}), ' | ' ORDER BY rn) FILTER (rn <= 5) AS evidence,
  bool_or({_SHIPPED}) FILTER (rn <= 5) AS head, count(*) - least(5, count(*)) AS n_further FROM r GROUP BY ALL HAVING TRUE)""".replace("GROUP BY ALL HAVING TRUE", "GROUP BY target, version, rule_id")


@query("matches_to_findings", f"WITH {_FINDINGS} SELECT target, version, rule_id, 'SOURCE_CODE' AS area, severity, confidence, title, evidence, n_further FROM fd")
def _(spark, sf_dir):
    return _shown(findings.matches_to_findings(_saved(spark, sf_dir)))


@query("matches_to_capabilities", f"""WITH {_MATCHES}, r AS (SELECT *, row_number() OVER (PARTITION BY target, version, capability ORDER BY deep, path, line, rule_no) AS rn FROM m WHERE capability IS NOT NULL)
SELECT target, version, capability, min_by(title, rn) AS description, count(*) AS n, string_agg(path || ':' || line, ' ' ORDER BY rn) FILTER (rn <= 3) AS evidence FROM r GROUP BY target, version, capability""")
def _(spark, sf_dir):
    got = findings.matches_to_capabilities(_saved(spark, sf_dir))
    return got.withColumn("evidence", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["path"], e["line"].cast("string"))), " "))


_VERDICT = f"""v AS (SELECT target, version, coalesce(max(CASE WHEN head THEN greatest(0, {_SEV.format('severity')} - CASE WHEN confidence = 'LOW' THEN 1 ELSE 0 END) END), 0) AS r, count(*) AS n_findings FROM fd GROUP BY target, version),
vd AS (SELECT target, version, {_SEVS}[CAST(r AS INT) + 1] AS overall, CAST(CASE WHEN r = 5 THEN 3 WHEN r = 4 THEN 2 WHEN r >= 2 THEN 1 ELSE 0 END AS INT) AS exit_code, n_findings FROM v)"""


@query("overall_verdict", f"WITH {_FINDINGS}, {_VERDICT} SELECT * FROM vd")
def overall_verdict(spark, sf_dir):
    return findings.overall_verdict(findings.matches_to_findings(_saved(spark, sf_dir))).drop("recommendation")


@query("gate", f"WITH {_FINDINGS}, {_VERDICT} SELECT target, version, overall FROM vd WHERE exit_code >= 3")
def _(spark, sf_dir):
    return findings.gate(overall_verdict(spark, sf_dir), "critical").select("target", "version", "overall")


@query("area_severities", f"WITH {_FINDINGS} SELECT target, version, 'SOURCE_CODE' AS area, {_SEVS}[CAST(max({_SEV.format('severity')}) AS INT) + 1] AS severity, count(*) AS n_findings, CASE WHEN NOT bool_or(head) THEN 'not in the verdict' END AS note FROM fd GROUP BY target, version")
def _(spark, sf_dir):
    return findings.area_severities(findings.matches_to_findings(_saved(spark, sf_dir)))


@query("fleet_summary", f"WITH {_FINDINGS} SELECT target, place, severity, count(*) AS n FROM (SELECT target, CASE WHEN head THEN 'shipped' ELSE 'outside' END AS place, severity FROM fd) GROUP BY ROLLUP (target, place, severity)")
def _(spark, sf_dir):
    return findings.fleet_summary(findings.matches_to_findings(_saved(spark, sf_dir)))


@query("worst_targets", f"WITH {_FINDINGS}, {_VERDICT} SELECT target, version, overall FROM vd ORDER BY {_SEV.format('overall')} DESC, target, version LIMIT 10")
def _(spark, sf_dir):
    return findings.worst_targets(overall_verdict(spark, sf_dir), 10).select("target", "version", "overall")


_ORDER = f"{_SEV.format('severity')} DESC, list_position(['LOW', 'MEDIUM', 'HIGH'], confidence) DESC, rule_id, title"


@query("sort_findings", f"WITH {_FINDINGS} SELECT target, version, rule_id, CAST(row_number() OVER (PARTITION BY target, version ORDER BY {_ORDER}) AS INT) AS place FROM fd")
def _(spark, sf_dir):
    return findings.sort_findings(findings.matches_to_findings(_saved(spark, sf_dir))).select("target", "version", "rule_id", "place")


@query("sarif_results", f"""WITH {_FINDINGS}, o AS (SELECT *, row_number() OVER (PARTITION BY target, version ORDER BY {_ORDER}) - 1 AS i FROM fd)
SELECT target, version, rule_id, CAST(i AS INT) AS rule_index, CASE WHEN NOT head THEN 'note' WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' ELSE 'warning' END AS level, string_split(evidence, ':')[1] AS uri,
  substr(sha256(rule_id || chr(31) || string_split(evidence, ':')[1] || chr(31) || (SELECT any_value(trim(m.text)) FROM m WHERE m.target = o.target AND m.version = o.version AND m.rule_id = o.rule_id AND m.path = string_split(o.evidence, ':')[1] AND m.line = CAST(string_split(o.evidence, ':')[2] AS INT))), 1, 32) AS fingerprint FROM o""")
def _(spark, sf_dir):
    return writers.sarif_results(findings.matches_to_findings(_saved(spark, sf_dir))).select("target", "version", "rule_id", "rule_index", "level", "uri", "fingerprint")


@query("sarif_logs")
def _(spark, sf_dir):
    return writers.sarif_logs(findings.matches_to_findings(_saved(spark, sf_dir)))


_ESC = lambda x: rf"regexp_replace({x}, '([\\`*_{{}}\[\]()#+!|~-])', '\\\1', 'g')"


@query("summary_rows", f"""WITH {_FINDINGS}, o AS (SELECT *, row_number() OVER (PARTITION BY target, version ORDER BY {_ORDER}) AS place, count(*) OVER (PARTITION BY target, version) AS n FROM fd)
SELECT target, version, CAST(place AS INT) AS place, severity, confidence, {_ESC('rule_id')} AS rule, {_ESC("string_split(evidence, ':')[1] || ':' || string_split(evidence, ':')[2]")} AS first_evidence, head AS sets_verdict, greatest(0, n - 5) AS n_hidden FROM o WHERE place <= 5""")
def _(spark, sf_dir):
    return writers.summary_rows(findings.matches_to_findings(_saved(spark, sf_dir)), 5)


@query("combination_findings", f"""WITH {_MATCHES}, c AS (SELECT target, version, bool_or(capability = 'encoding.base64') AND bool_or(capability = 'code.eval') AS a, bool_or(capability = 'package.install') AND bool_or(capability IN ('shell.execute', 'process.spawn')) AS b FROM m GROUP BY target, version)
SELECT target, version, 'combo.decode_then_execute' AS rule_id, 'CRITICAL' AS severity FROM c WHERE a UNION ALL SELECT target, version, 'combo.runtime_package_install', 'HIGH' FROM c WHERE b""")
def _(spark, sf_dir):
    return findings.combination_findings(_saved(spark, sf_dir)).select("target", "version", "rule_id", "severity")


@query("match_context")
def _(spark, sf_dir):
    lines = views.code_lines(spark, sf_dir)
    return matches.match_context(matches.match_rules(lines), lines).select("target", "version", "path", "line", "rule_id", "context")


# --- flows -------------------------------------------------------------------------------------------------

_FLOWS = f"""{_MATCHES},
p AS (SELECT s.target, s.version, s.path, s.rule_id AS source_rule, k.rule_id AS sink_rule, coalesce(s.capability, s.rule_id) AS source, coalesce(k.capability, k.rule_id) AS sink, abs(s.line - k.line) AS distance, s.line AS source_line, k.line AS sink_line,
  row_number() OVER (PARTITION BY s.target, s.version, s.path, s.rule_id, k.rule_id ORDER BY abs(s.line - k.line), s.line, k.line) AS rn
  FROM m s JOIN m k ON s.target = k.target AND s.version = k.version AND s.path = k.path AND s.role = 'source' AND k.role IN ('sink', 'exec')),
fl AS (SELECT * EXCLUDE (rn), CASE WHEN distance <= 40 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM p WHERE rn = 1)"""


@query("pair_flows", f"WITH {_FLOWS} SELECT * FROM fl")
def _(spark, sf_dir):
    return flows.pair_flows(_saved(spark, sf_dir)).drop("source_text", "sink_text", "source_seen", "sink_seen")


@query("nearest_url", f"""WITH {_FLOWS}, url AS (SELECT target, version, path, line, regexp_extract(text, 'https?://([A-Za-z0-9._~-]+(?::\\d+)?)', 1) AS host FROM lines WHERE contains(text, '://')),
near AS (SELECT f.*, u.host, row_number() OVER (PARTITION BY f.target, f.version, f.path, f.source_rule, f.sink_rule ORDER BY abs(u.line - f.sink_line) NULLS LAST, u.line) AS rn
  FROM fl f LEFT JOIN url u ON u.host <> '' AND u.target = f.target AND u.version = f.version AND u.path = f.path AND abs(u.line - f.sink_line) <= 40 AND f.sink IN ({_LIST(OUTBOUND)}) AND f.sink_rule <> 'source.llm_api_call')
SELECT target, version, path, source_rule, sink_rule, sink_line, host AS destination FROM near WHERE rn = 1""")
def _(spark, sf_dir):
    got = flows.with_destination(saved(flows.pair_flows(_saved(spark, sf_dir)), "flows"), views.code_lines(spark, sf_dir))
    return got.select("target", "version", "path", "source_rule", "sink_rule", "sink_line", "destination")


@query("flow_cap", f"""WITH {_FLOWS} SELECT target, version, path, source_rule, sink_rule, CAST(rn AS INT) AS rn, n - 12 AS n_hidden FROM (SELECT *, row_number() OVER (PARTITION BY target, version ORDER BY list_position(['LOW', 'MEDIUM', 'HIGH'], confidence) DESC, source, sink, path, s1, k1) AS rn, count(*) OVER (PARTITION BY target, version) AS n
  FROM fl JOIN (SELECT target, version, path, rule_id AS source_rule, min(line * 1000 + rule_no) AS s1 FROM m GROUP BY ALL) USING (target, version, path, source_rule) JOIN (SELECT target, version, path, rule_id AS sink_rule, min(line * 1000 + rule_no) AS k1 FROM m GROUP BY ALL) USING (target, version, path, sink_rule)) WHERE rn <= 12""")
def _(spark, sf_dir):
    return flows.flow_cap(saved(flows.pair_flows(_saved(spark, sf_dir)), "flows")).select("target", "version", "path", "source_rule", "sink_rule", "rn", "n_hidden")


@query("dataflow_findings", f"""WITH {_FLOWS} SELECT target, version, 'dataflow.' || source || '__' || sink AS rule_id, CASE source {' '.join(f"WHEN {_q(k)} THEN {_q(v[0])}" for k, v in EXFIL_WORTHY.items())} END AS severity, confidence, path, source_line, sink_line FROM fl WHERE sink IN ({_LIST(OUTBOUND)}) AND source IN ({_LIST(EXFIL_WORTHY)})""")
def _(spark, sf_dir):
    got = flows.dataflow_findings(flows.pair_flows(_saved(spark, sf_dir)))
    e = lambda i, c: F.col("evidence")[i][c]
    return got.select("target", "version", "rule_id", "severity", "confidence", e(0, "path").alias("path"), e(0, "line").alias("source_line"), e(1, "line").alias("sink_line"))


# --- hosts and credentials ---------------------------------------------------------------------------------

_ENV = " UNION ALL ".join(f"SELECT target, version, path, line, text, {i} AS pattern, unnest(regexp_extract_all(text, {_q(p)}, 1)) AS name FROM lines" for i, p in enumerate(network.ENV_NAMES))


@query("extract_credentials", f"""WITH {_LINES}, e AS ({_ENV}),
r AS (SELECT *, row_number() OVER (PARTITION BY target, version, name ORDER BY CASE WHEN contains(path, '/') THEN 1 ELSE 0 END, path, line, pattern) AS rn FROM e WHERE regexp_matches(name, {_q(network.SECRETISH)}))
SELECT target, version, name, NOT (contains(text, '.get(') OR contains(text, 'getenv(')) AS required, path, line FROM r WHERE rn = 1""")
def _(spark, sf_dir):
    return network.extract_credentials(views.code_lines(spark, sf_dir)).select("target", "version", "name", "required", "path", "line")


@query("extract_endpoints", f"WITH {_LINES}, {_ENDPOINTS} SELECT * FROM ep")
def _(spark, sf_dir):
    return network.extract_endpoints(views.code_lines(spark, sf_dir), F.lit("example service")).drop("snippet", "reason")


@query("page_hosts", f"WITH lines AS ({views.page_lines_sql('pages')}), {_ENDPOINTS} SELECT * FROM ep")
def _(spark, sf_dir):
    return network.extract_endpoints(views.page_lines(spark, sf_dir), F.lit("example service")).drop("snippet", "reason")


@query("sort_endpoints", f"WITH {_LINES}, {_ENDPOINTS} SELECT target, version, host, CAST(row_number() OVER (PARTITION BY target, version ORDER BY list_position(['SUSPICIOUS', 'UNEXPLAINED', 'EXPECTED', 'INFRASTRUCTURE'], classification), host) AS INT) AS place FROM ep")
def _(spark, sf_dir):
    return network.sort_endpoints(network.extract_endpoints(views.code_lines(spark, sf_dir), F.lit("example service"))).select("target", "version", "host", "place")


@query("network_findings", f"""WITH {_LINES}, {_ENDPOINTS} SELECT target, version, 'network.suspicious_destination' AS rule_id, 'HIGH' AS severity, count(*) AS n FROM ep WHERE classification = 'SUSPICIOUS' GROUP BY target, version
UNION ALL SELECT target, version, 'network.cleartext_http', 'MEDIUM', count(*) FROM ep WHERE plain_http AND classification <> 'INFRASTRUCTURE' GROUP BY target, version""")
def _(spark, sf_dir):
    got = network.network_findings(network.extract_endpoints(views.code_lines(spark, sf_dir), F.lit("example service")))
    return got.select("target", "version", "rule_id", "severity", (F.size("evidence") + F.col("n_further")).alias("n"))


# --- versions ----------------------------------------------------------------------------------------------

_SETS = f"""{_MATCHES}, e AS ({_ENV}), {_ENDPOINTS},
s AS (SELECT DISTINCT target, version, 'capability' AS kind, capability AS item FROM m WHERE capability IS NOT NULL UNION SELECT target, version, 'credential', name FROM e WHERE regexp_matches(name, {_q(network.SECRETISH)}) UNION SELECT target, version, 'endpoint', host FROM ep),
ch AS (SELECT target, kind, item, CASE WHEN bool_or(version = 'v2') THEN 'added' ELSE 'removed' END AS change FROM s WHERE target IN (SELECT target FROM s GROUP BY target HAVING count(DISTINCT version) = 2) GROUP BY target, kind, item HAVING count(DISTINCT version) = 1)"""


@query("diff_versions", f"WITH {_SETS} SELECT * FROM ch")
def _(spark, sf_dir):
    return audit.drift(views.code_lines(spark, sf_dir), "v1", "v2")[0]


@query("diff_findings", f"""WITH {_SETS}, esc(item, severity) AS (VALUES {', '.join(f'({_q(k)}, {_q(v)})' for k, v in ESCALATION.items())})
SELECT target, 'diff.capability_added.' || item AS rule_id, severity FROM ch JOIN esc USING (item) WHERE change = 'added' AND kind = 'capability'
UNION ALL SELECT DISTINCT target, 'diff.credentials_added', 'HIGH' FROM ch WHERE change = 'added' AND kind = 'credential' UNION ALL SELECT DISTINCT target, 'diff.endpoints_added', 'MEDIUM' FROM ch WHERE change = 'added' AND kind = 'endpoint'""")
def _(spark, sf_dir):
    return audit.drift(views.code_lines(spark, sf_dir), "v1", "v2")[1].select("target", "rule_id", "severity")


@query("version_drift", f"""WITH {_MATCHES}, s AS (SELECT target, version, list(DISTINCT capability) AS items FROM m WHERE capability IS NOT NULL GROUP BY target, version), b AS (SELECT *, coalesce(lag(items) OVER (PARTITION BY target ORDER BY version), []) AS before FROM s)
SELECT target, version, array_to_string(list_sort(list_filter(items, lambda x: NOT list_contains(before, x))), ',') AS added, array_to_string(list_sort(list_filter(before, lambda x: NOT list_contains(items, x))), ',') AS removed FROM b""")
def _(spark, sf_dir):
    found = _found(spark, sf_dir)
    sets = found.where("capability is not null").select("target", "version", F.lit("capability").alias("kind"), F.col("capability").alias("item")).distinct()
    return diff.version_drift(sets).select("target", "version", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


# --- documents, installation, dependencies ------------------------------------------------------------------

_DOC_SPLIT = "SELECT doc_id, source, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos, unnest(string_split(text, chr(10))) AS x FROM {documents}"
_SIGNALS = ", ".join(f"({_q(s.rule_id)}, {_q(s.pattern)}, {_q(s.severity)})" for s in injection.SIGNALS if s.severity != "INFO")


@query("detect_doc_injection", f"""WITH lines AS ({views.doc_lines_sql('documents', _DOC_SPLIT)}), sig(rule_id, pattern, severity) AS (VALUES {_SIGNALS}),
h AS (SELECT target, version, path, rule_id, any_value(severity) AS severity, count(*) AS n, min(line) AS line FROM lines JOIN sig ON regexp_matches(text, pattern) GROUP BY target, version, path, rule_id)
SELECT target, version, path, rule_id || '.documentation' AS rule_id, {_SEVS}[CAST({_SEV.format('severity')} AS INT)] AS severity, 'LOW' AS confidence, n, line FROM h""")
def _(spark, sf_dir):
    got = injection.detect_doc_injection(views.doc_lines(spark, sf_dir))
    e = F.col("evidence")[0]
    return got.select("target", "version", e["path"].alias("path"), "rule_id", "severity", "confidence", (F.size("evidence") + F.col("n_further")).alias("n"), e["line"].alias("line"))


@query("detect_install_risk", f"""WITH {_LINES} SELECT target, version, 'install.remote_script_execution' AS rule_id, 'CRITICAL' AS severity, count(*) AS n FROM lines
WHERE regexp_matches(lower(path), '\\.(sh|bash|zsh|md)$') AND regexp_matches(text, {_q(install.REMOTE_PIPE)}) AND NOT regexp_matches(text, {_q(install.SHOWN_ONLY)}) GROUP BY target, version""")
def _(spark, sf_dir):
    return install.detect_install_risk(views.code_lines(spark, sf_dir)).select("target", "version", "rule_id", "severity", (F.size("evidence") + F.col("n_further")).alias("n"))


@query("dependency_summary", f"""WITH d AS ({views.dep_specs_sql('part')}), k AS (SELECT *, CASE WHEN regexp_matches(spec, '^(?:git\\+|github:|git:|https?:|file:)') THEN 'remote' WHEN spec IN ('*', 'latest', '') OR regexp_matches(spec, '^[\\^~>]') THEN 'floating' ELSE 'pinned' END AS kind FROM d)
SELECT target, CAST(count(*) AS INT) AS n_direct, CAST(count(*) FILTER (kind = 'floating') AS INT) AS n_floating, CAST(count(*) FILTER (kind = 'remote') AS INT) AS n_remote, count(*) FILTER (kind = 'floating') > 0.5 * count(*) AS mostly_floating FROM k GROUP BY target""")
def _(spark, sf_dir):
    specs = views.dep_specs(spark, sf_dir)
    text = F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("name", "spec"))).alias("dependencies")))
    files = specs.groupBy("target").agg(text.alias("text")).select("target", F.lit("v1").alias("version"), F.lit("package.json").alias("path"), "text")
    return dependencies.dependency_summary(dependencies.analyze_dependencies(files)).select("target", "n_direct", "n_floating", "n_remote", "mostly_floating")


# --- metadata ----------------------------------------------------------------------------------------------


def _now():
    return F.lit(NOW).cast("timestamp")


@query("assess_popularity", f"""WITH {_REPOS}, a AS (SELECT full_name, stars, forks, {_AGE('created_at')} AS age_days, CASE WHEN stars > 0 THEN forks * 1.0 / stars ELSE 0 END AS ratio FROM repos)
SELECT full_name, stars, forks, age_days, round(CAST(ratio AS DOUBLE), 6) AS fork_ratio, stars > 300 AND age_days < 2200 AND ratio < 0.075 AS flagged FROM a""")
def _(spark, sf_dir):
    got = metadata.assess_popularity(views.repos(spark, sf_dir), _now(), least_stars=300, most_age=2200, most_ratio=0.075)
    return got.select("full_name", "stars", "forks", "age_days", F.round("fork_ratio", 6).alias("fork_ratio"), "flagged")


_TRUST = f"""{_REPOS}, a AS (SELECT *, {_AGE('pushed_at')} AS idle, {_AGE('created_at')} AS age FROM repos),
tf AS (SELECT full_name AS target, 'trust.archived' AS rule_id, 'MEDIUM' AS severity FROM a WHERE archived UNION ALL SELECT full_name, 'trust.disabled', 'HIGH' FROM a WHERE disabled UNION ALL SELECT full_name, 'trust.stale', 'LOW' FROM a WHERE idle > 180 AND NOT archived
UNION ALL SELECT full_name, 'trust.no_license', 'LOW' FROM a WHERE license IS NULL UNION ALL SELECT full_name, 'trust.is_fork', 'LOW' FROM a WHERE fork UNION ALL SELECT full_name, 'trust.very_new', 'INFO' FROM a WHERE age < 30
UNION ALL SELECT full_name, 'trust.single_maintainer', 'INFO' FROM a WHERE contributors < 2 UNION ALL SELECT full_name, 'trust.no_releases', 'LOW' FROM a WHERE releases = 0)"""


def _trust(spark, sf_dir):
    return metadata.assess_trust(views.repos(spark, sf_dir).withColumn("errors", F.array().cast("array<string>")), _now())


@query("assess_trust", f"WITH {_TRUST} SELECT * FROM tf")
def _(spark, sf_dir):
    return _trust(spark, sf_dir).select("target", "rule_id", "severity")


@query("trust_areas", f"""WITH {_TRUST}, w AS (SELECT target, CASE WHEN rule_id IN ('trust.archived', 'trust.stale') THEN 'MAINTENANCE' ELSE 'REPOSITORY_TRUST' END AS area, max({_SEV.format('severity')}) AS r FROM tf WHERE rule_id <> 'trust.no_releases' AND severity <> 'INFO' GROUP BY 1, 2)
SELECT full_name AS target, x.area, coalesce({_SEVS}[CAST(r AS INT) + 1], 'NOT_FLAGGED') AS severity FROM repos CROSS JOIN (VALUES ('REPOSITORY_TRUST'), ('MAINTENANCE')) x(area) LEFT JOIN w ON w.target = full_name AND w.area = x.area""")
def _(spark, sf_dir):
    return metadata.trust_areas(_trust(spark, sf_dir), views.repos(spark, sf_dir))


_LATEST = f"{_REG}, latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY coalesce(is_latest, FALSE) DESC, seq) AS rn FROM reg) WHERE rn = 1)"


@query("dedupe_latest_registry", f"WITH {_LATEST} SELECT name, version, entry FROM latest")
def _(spark, sf_dir):
    return views.latest_registry(spark, sf_dir).select("name", "version", "entry")


@query("distinct_registry_versions", f"WITH {_REG} SELECT name, version, entry FROM (SELECT *, row_number() OVER (PARTITION BY name, version ORDER BY seq) AS rn FROM reg) WHERE rn = 1")
def _(spark, sf_dir):
    return views.registry_versions(spark, sf_dir).select("name", "version", "entry")


@query("provenance", f"""WITH {_REPOS}, {_LATEST}, e AS (SELECT *, {_NORM(_CLEAN('repository_url'))} AS repo FROM latest), a AS (SELECT *, {_NORM(_CLEAN('html_url'))} AS repo FROM repos)
SELECT full_name, a.repo, name AS registry_name, CASE WHEN name IS NULL THEN 'NOT_APPLICABLE' ELSE 'VERIFIED' END AS provenance_status FROM a LEFT JOIN e ON a.repo = e.repo""")
def _(spark, sf_dir):
    got = metadata.provenance(views.repos(spark, sf_dir), views.latest_registry(spark, sf_dir))
    return got.select("full_name", "repo", "registry_name", "provenance_status")


@query("unregistered_repos", f"""WITH {_REPOS}, {_LATEST} SELECT full_name FROM repos WHERE NOT EXISTS (SELECT 1 FROM latest WHERE {_NORM(_CLEAN('repository_url'))} = {_NORM(_CLEAN('html_url'))})""")
def _(spark, sf_dir):
    return metadata.unregistered_repos(views.repos(spark, sf_dir), views.latest_registry(spark, sf_dir)).select("full_name")


def _audited(spark, sf_dir):
    """Repositories as if audited under the registry name of the same number."""
    repos = views.repos(spark, sf_dir).select(F.col("full_name").alias("target"), F.concat(F.lit("io.reg/srv"), F.col("k")).alias("name"), F.concat(F.lit("https://github.com/"), "full_name").alias("html_url"))
    return repos, views.latest_registry(spark, sf_dir)


_AUDITED = f"{_REPOS}, {_LATEST}, au AS (SELECT full_name AS target, 'https://github.com/' || full_name AS html, l.* FROM repos JOIN latest l ON l.name = 'io.reg/srv' || k)"
_DIFFERS = f"coalesce({_NORM(_CLEAN('repository_url'))} <> {_NORM(_CLEAN('html'))}, FALSE)"


@query("registry_mismatch", f"WITH {_AUDITED} SELECT target, name FROM au WHERE {_DIFFERS}")
def _(spark, sf_dir):
    return metadata.registry_mismatch(*_audited(spark, sf_dir)).select("target", "name")


@query("assess_provenance", f"""WITH {_AUDITED} SELECT target, 'provenance.registry_source_mismatch' AS rule_id, 'HIGH' AS severity FROM au WHERE {_DIFFERS} UNION ALL SELECT target, 'provenance.no_declared_source', 'MEDIUM' FROM au WHERE repository_url IS NULL
UNION ALL SELECT target, 'provenance.registry_status', 'MEDIUM' FROM au WHERE status <> 'active' UNION ALL SELECT target, 'provenance.remote_only_server', 'MEDIUM' FROM au WHERE is_remote_only""")
def _(spark, sf_dir):
    repos, entries = _audited(spark, sf_dir)
    return metadata.assess_provenance(repos.join(entries, "name").withColumn("remotes", F.array(F.lit("sse: https://x")))).select("target", "rule_id", "severity")


@query("search_repos", f"WITH {_REPOS} SELECT full_name, stars FROM repos WHERE contains(lower(full_name || ' ' || description), 'machinery') ORDER BY stars DESC, full_name LIMIT 20")
def _(spark, sf_dir):
    return metadata.search_repos(views.repos(spark, sf_dir), "machinery", 20).select("full_name", "stars")


@query("search_registry", f"""WITH {_LATEST}, q(query, words) AS (SELECT query, list_filter(string_split_regex(lower(query), '\\s+'), lambda w: length(w) > 2) FROM (SELECT DISTINCT 'srv' || (p_partkey % 20) || ' ' || p_name AS query FROM part)),
s AS (SELECT query, name, len(list_filter(words, lambda w: contains(lower(concat_ws(' ', name, description)), w))) AS score FROM latest JOIN q ON len(list_filter(words[1:4], lambda w: contains(lower(name), w))) > 0)
SELECT query, name, CAST(score AS INT) AS score, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, name) AS place FROM s) WHERE place <= 5""")
def _(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("srv"), (F.col("p_partkey") % 20).cast("string"), F.lit(" "), "p_name").alias("query")).distinct()
    return metadata.search_registry(views.latest_registry(spark, sf_dir), asked, 5)


@query("snapshot_freshness", """WITH l AS (SELECT concat('t', user_id % 20) AS target, event_type AS key, user_id, max(ts) AS last_at FROM events GROUP BY 1, 2, 3), a AS (SELECT target, CAST(epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(last_at)) AS BIGINT) AS age FROM l)
SELECT target, count(*) AS n_keys, count(*) FILTER (age > 86400) AS n_stale, max(age) AS oldest_seconds FROM a GROUP BY target""")
def _(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("t"), (F.col("user_id") % 20).cast("string")).alias("target"), F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("fetched_at"))
    return metadata.snapshot_freshness(events, F.lit("2024-01-31 00:00:00").cast("timestamp"), 86400)


# --- text helpers over the given tables --------------------------------------------------------------------


@query("file_roles", """WITH p AS (SELECT path, lower(string_split(path, '/')[-1]) AS base, lower(path) AS low FROM (SELECT DISTINCT regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[?#].*$', '') || CASE page_id % 6 WHEN 0 THEN '.md' WHEN 1 THEN '/tests/a.py' WHEN 2 THEN '_test.js' WHEN 3 THEN '/Scripts/x.sh' WHEN 4 THEN '.py' ELSE '/demo.ts' END AS path FROM pages))
SELECT path, CASE WHEN regexp_matches(base, '[^.].*\\.(md|mdx|rst|txt|adoc)$') THEN 'docs' WHEN regexp_matches(low, '(^|/)(test|tests|testing|__tests__|spec|specs|fixture|fixtures|testdata|test_data|e2e|conftest)/') OR regexp_matches(base, '(^|[._-])(test|tests|spec|conftest|fixtures?)([._-]|$)|^test_') THEN 'test'
  WHEN regexp_matches(low, '(^|/)(\\.github|\\.gitlab|\\.circleci|scripts|script|tools|hack|ci|build-tools|devtools|examples|example|samples|sample|demo|demos|benchmarks|benchmark)/') THEN 'dev' ELSE 'shipped' END AS role FROM p""")
def _(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ends = F.get(F.array(*map(F.lit, (".md", "/tests/a.py", "_test.js", "/Scripts/x.sh", ".py", "/demo.ts"))), (F.col("page_id") % 6).cast("int"))
    path = F.concat(F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*/", ""), "[?#].*$", ""), ends)
    return pages.select(path.alias("path")).distinct().select("path", t.file_role(F.col("path")).alias("role"))


@query("path_uris")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", t.path_uri(F.col("url"), "base").alias("uri"))


@query("snippets", f"SELECT doc_id, CAST(pos AS INT) AS line, CASE WHEN length(trim(x)) > 80 THEN substr(trim(x), 1, 79) || '…' ELSE trim(x) END AS snippet FROM ({_DOC_SPLIT.format(documents='documents')})")
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "x"))
    return lines.select("doc_id", (F.col("at") + 1).alias("line"), t.snippet(F.col("x"), 80).alias("snippet"))


# --- streams and whole workloads ---------------------------------------------------------------------------


@query("first_seen_capability", f"WITH {_MATCHES}, ev AS (SELECT concat('t', user_id % 20) AS target, text, ts FROM (SELECT user_id, ts, {views.case(f'event_id % {len(views.SAMPLES)}', views.SAMPLES)} AS text FROM events)) SELECT ev.target, h.capability, min(ev.ts) AS first_seen FROM ev JOIN hits h ON ev.text = h.text AND h.ext = '.py' WHERE h.capability IS NOT NULL GROUP BY 1, 2")
def _(spark, sf_dir):
    sql = f"SELECT concat('t', user_id % 20) AS target, 'v1' AS version, 'server.py' AS path, CAST(event_id AS INT) AS line, ts, {views.case(f'event_id % {len(views.SAMPLES)}', views.SAMPLES)} AS text FROM :events"
    events = views.over(spark, sql, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return streams.first_seen(streams.stream_matches(events))


@query("audit_findings")
def audit_findings(spark, sf_dir):
    return audit.audit_findings(saved(views.code_lines(spark, sf_dir), "lines"), F.lit("example service"))


@query("audit_verdicts")
def audit_verdicts(spark, sf_dir):
    return findings.overall_verdict(audit_findings(spark, sf_dir))
