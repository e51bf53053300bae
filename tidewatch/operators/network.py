"""Hosts and credentials that the code names, and findings about hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import enums
from tidewatch.functions.hosts import LOCAL, TELEMETRY, classify_host, purpose_tokens, urls_in
from tidewatch.functions.text import snippet, walk_key
from tidewatch.functions.unions import union_all
from tidewatch.operators.findings import evidence, finding

# How code reads the environment, and what names look like secrets.
ENV_NAMES = (
    r"os\.environ\s*\[\s*['\"]([A-Za-z_][A-Za-z0-9_]*)['\"]",
    r"os\.environ\.get\s*\(\s*['\"]([A-Za-z_][A-Za-z0-9_]*)['\"]",
    r"os\.getenv\s*\(\s*['\"]([A-Za-z_][A-Za-z0-9_]*)['\"]",
    r"process\.env\.([A-Za-z_][A-Za-z0-9_]*)",
    r"process\.env\s*\[\s*['\"]([A-Za-z_][A-Za-z0-9_]*)['\"]",
    r"getenv\s*\(\s*['\"]([A-Za-z_][A-Za-z0-9_]*)['\"]",
)
SECRETISH = r"(?i)TOKEN|KEY|SECRET|PASSWORD|PASSWD|CREDENTIAL|AUTH|PRIVATE|SESSION|COOKIE|DSN|WEBHOOK"
# What a known credential opens, in our own words.
BLAST_RADIUS = {
    "GITHUB_TOKEN": "all permissions of the token over repositories and organisations", "GH_TOKEN": "all permissions of the token over repositories and organisations",
    "AWS_SECRET_ACCESS_KEY": "all that the cloud principal may do", "AWS_ACCESS_KEY_ID": "half of a cloud principal's key pair",
    "OPENAI_API_KEY": "billable calls and the project's data", "ANTHROPIC_API_KEY": "billable calls", "SLACK_TOKEN": "reading and posting in the token's channels",
    "DISCORD_TOKEN": "the bot's full access", "DATABASE_URL": "direct access to the database", "STRIPE_SECRET_KEY": "live payments", "NPM_TOKEN": "publishing packages",
}


def extract_credentials(lines: DataFrame) -> DataFrame:
    """(target, version, name, required, blast_radius, path, line, snippet): secret-looking environment names, first occurrence.

    Names only, never values. A name is required where its first line has neither .get( nor getenv(.
    """
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), lambda n, i=i: F.struct(n.alias("name"), F.lit(i).alias("pattern"))) for i, p in enumerate(ENV_NAMES)]))
    rows = lines.where(F.col("text").contains("env")).select("target", "version", "path", "line", "text", F.explode(found).alias("f")).where(F.col("f.name").rlike(SECRETISH))
    place = F.struct(walk_key(F.col("path")).alias("walk"), "line", F.col("f.pattern").alias("pattern"))
    first = rows.groupBy("target", "version", F.col("f.name").alias("name")).agg(F.min_by(F.struct("path", "line", "text"), place).alias("e"))
    radius = F.create_map(*[F.lit(x) for kv in BLAST_RADIUS.items() for x in kv])
    optional = F.col("e.text").contains(".get(") | F.col("e.text").contains("getenv(")
    return first.select("target", "version", "name", (~optional).alias("required"), F.coalesce(radius[F.col("name")], F.lit("unknown: assume all that its issuer allows")).alias("blast_radius"), "e.path", "e.line", snippet(F.col("e.text")).alias("snippet"))


def extract_endpoints(lines: DataFrame, purpose: Column | None = None) -> DataFrame:
    """(target, version, host, scheme, classification, plain_http, n, path, line, snippet) of every URL host; the first occurrence decides.

    purpose is the target's own text (a column of lines or a literal).
    """
    tokens = purpose_tokens(purpose if purpose is not None else F.lit(""))
    rows = lines.where(F.col("text").contains("://")).select("target", "version", "path", "line", "text", tokens.alias("tokens"), F.posexplode(urls_in(F.col("text"))).alias("at", "u"))
    place = F.struct(walk_key(F.col("path")).alias("walk"), "line", "at")
    first = rows.groupBy("target", "version", F.col("u.host").alias("host")).agg(F.min_by(F.struct("u.scheme", "path", "line", "text", "tokens"), place).alias("e"), F.count("*").alias("n"))
    plain = (F.col("e.scheme") == "http") & ~F.col("host").isin(*LOCAL)
    return first.select("target", "version", "host", "e.scheme", classify_host(F.col("host"), F.col("e.tokens")).alias("classification"), plain.alias("plain_http"), "n", "e.path", "e.line", snippet(F.col("e.text")).alias("snippet")).withColumn("reason", reason(F.col("host"), F.col("classification"), F.col("plain_http")))


def reason(host: Column, classification: Column, plain_http: Column) -> Column:
    """Why a host has its class, in a few words."""
    words = (
        F.when(host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") & (classification == "SUSPICIOUS"), "a bare address without a name")
        .when(classification == "SUSPICIOUS", "a known paste, tunnel or capture service")
        .when(host.isin(*TELEMETRY), "collects usage data")
        .when(classification == "INFRASTRUCTURE", "part of common development infrastructure")
        .when(classification == "EXPECTED", "its name occurs in what the tool says it is for")
        .otherwise("nothing that the tool says about itself explains it")
    )
    return F.concat(words, F.when(plain_http, "; over plain http").otherwise(""))


def sort_endpoints(endpoints: DataFrame) -> DataFrame:
    """endpoints with place: suspicious, unexplained, expected, infrastructure, then by host."""
    w = Window.partitionBy("target", "version").orderBy(enums.rank(F.col("classification"), enums.ENDPOINT_CLASSES), "host")
    return endpoints.withColumn("place", F.row_number().over(w))


def network_findings(endpoints: DataFrame) -> DataFrame:
    """Suspicious destinations (HIGH) and plain http to hosts that are no infrastructure (MEDIUM); three pieces of evidence."""
    ordered = sort_endpoints(endpoints)

    def group(rows: DataFrame, rule: str, severity: str, title: str) -> DataFrame:
        first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("target", "version").orderBy("place"))).groupBy("target", "version").agg(
            F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", evidence(F.col("path"), F.col("line"), F.col("snippet")).alias("e"))))).alias("first"), F.count("*").alias("n")
        )
        return first.select("target", "version", *finding(F.lit(rule), "NETWORK", F.lit(severity), F.lit("MEDIUM"), F.lit(title), F.transform("first", lambda x: x["e"]), F.col("n") - F.size("first")))

    bad = group(ordered.where("classification = 'SUSPICIOUS'"), "network.suspicious_destination", "HIGH", "Talks to hosts that hide who listens")
    plain = group(ordered.where("plain_http and classification <> 'INFRASTRUCTURE'"), "network.cleartext_http", "MEDIUM", "Talks to other machines in the clear")
    return union_all(bad, plain)
