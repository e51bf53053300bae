"""Sensitive reads near outbound calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.catalogue import EXFIL_WORTHY, OUTBOUND
from tidewatch.functions.enums import confidence_rank
from tidewatch.functions.hosts import MODEL_HOSTS, URL_WITH_PORT
from tidewatch.functions.shared import saved
from tidewatch.functions.text import snippet
from tidewatch.functions.unions import union_all
from tidewatch.operators.findings import evidence, finding

FILE = ["target", "version", "path"]
NEAR = 40


def pair_flows(matches: DataFrame) -> DataFrame:
    """For each file, source rule and sink rule, the closest pair of lines; ties go to the first source, then sink line.

    Matches in prose and refusals are no half of a flow. Each sink meets only the last and the next line of each source rule
    of its file, told by two running values (one down, one up the file), so the work grows with the matches, not with their
    product. Lines alone are compared; the texts of the pairs that are left are fetched at the end.
    """
    real = matches.where(F.col("context").isNull())
    sources, sinks = real.where("role = 'source'"), real.where("role in ('sink', 'exec')")
    seen = lambda df, side: df.groupBy(*FILE, F.col("rule_id").alias(f"{side}_rule")).agg(F.min(F.struct("line", "rule_no")).alias(f"{side}_seen"))
    first_sources, first_sinks = saved(seen(sources, "source"), "sources"), saved(seen(sinks, "sink"), "sinks")
    both = union_all(
        sources.join(first_sinks.select(*FILE).distinct(), FILE, "left_semi").select(*FILE, F.col("rule_id").alias("source_rule"), "line", F.lit(0).alias("side")),
        sinks.select(*FILE, F.col("rule_id").alias("sink_rule"), "line", F.lit(1).alias("side")).join(first_sources.select(*FILE, "source_rule"), FILE),
    )
    w = Window.partitionBy(*FILE, "source_rule")
    running = lambda *order: F.last(F.when(F.col("side") == 0, F.col("line")), ignorenulls=True).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumns({"before": running("line", "side"), "after": running(F.desc("line"), F.desc("side"))}).where("side = 1")
    # A pair as one number, so that it is aggregated without a sort: its distance, its source line, whether the sink follows.
    pair = lambda s: F.shiftleft(F.abs(F.col(s) - F.col("line")).cast("long"), 32) + F.col(s).cast("long") * 2 + F.when(F.col("line") > F.col(s), 1).otherwise(0)
    keys = [*FILE, "source_rule", "sink_rule"]
    best = met.groupBy(*keys).agg(F.min(F.least(pair("before"), pair("after"))).alias("p"))
    distance, source_line = F.shiftright("p", 32).cast("int"), F.shiftright(F.col("p").bitwiseAND((1 << 32) - 1), 1).cast("int")
    best = best.withColumn("distance", distance).withColumn("source_line", source_line)
    best = saved(best.withColumn("sink_line", F.col("source_line") + F.when(F.col("p") % 2 == 1, F.col("distance")).otherwise(-F.col("distance"))).drop("p"), "pairs")

    def told(side: str) -> DataFrame:
        place = [*FILE, f"{side}_rule", f"{side}_line"]
        own = (sources if side == "source" else sinks).withColumnsRenamed({"rule_id": f"{side}_rule", "line": f"{side}_line"})
        return own.join(best.select(*place).distinct(), place, "left_semi").groupBy(*place).agg(F.min(F.struct("text", "capability")).alias(side))

    out = best
    for side, first in (("source", first_sources), ("sink", first_sinks)):
        out = out.join(told(side), [*FILE, f"{side}_rule", f"{side}_line"]).join(first, [*FILE, f"{side}_rule"])
    return out.select(
        *keys, F.coalesce("source.capability", "source_rule").alias("source"), F.coalesce("sink.capability", "sink_rule").alias("sink"), "distance", "source_line", "sink_line",
        F.col("source.text").alias("source_text"), F.col("sink.text").alias("sink_text"), F.when(F.col("distance") <= NEAR, "MEDIUM").otherwise("LOW").alias("confidence"), "source_seen", "sink_seen",
    )


def nearest_url(points: DataFrame, lines: DataFrame) -> DataFrame:
    """points (file, line) with destination: the first URL's host of the closest line within 40; ties go up."""
    urls = lines.withColumn("url", F.regexp_extract("text", URL_WITH_PORT, 1)).where("url <> ''").select(*FILE, "line", F.col("line").alias("at"), "url")
    asked = points.select(*FILE, "line").distinct().select(*FILE, "line", F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("url"))
    w = Window.partitionBy(*FILE).orderBy("line")
    up, down = w.rangeBetween(-NEAR, 0), w.rangeBetween(0, NEAR)
    near = union_all(urls, asked).withColumns({
        "up": F.last("at", ignorenulls=True).over(up), "up_url": F.last("url", ignorenulls=True).over(up), "down": F.first("at", ignorenulls=True).over(down), "down_url": F.first("url", ignorenulls=True).over(down),
    })
    upward = F.col("up").isNotNull() & (F.col("down").isNull() | (F.col("line") - F.col("up") <= F.col("down") - F.col("line")))
    # Rows of one line see the same window, so either of them will do.
    found = near.groupBy(*FILE, "line").agg(F.max(F.when(upward, F.col("up_url")).otherwise(F.col("down_url"))).alias("destination"))
    return points.join(found, [*FILE, "line"], "left")


def with_destination(flows: DataFrame, lines: DataFrame) -> DataFrame:
    """flows with destination, for network sinks only; a model call's destination is the host behind its model's prefix, not a URL."""
    network = F.col("sink").isin(*OUTBOUND) & (F.col("sink_rule") != "source.llm_api_call")
    found = nearest_url(flows.where(network).select(*FILE, F.col("sink_line").alias("line")).distinct(), lines).withColumnRenamed("line", "sink_line")
    out = flows.join(found, [*FILE, "sink_line"], "left")
    prefix = F.regexp_extract("sink_text", r"""\bmodel\s*=\s*["']([a-z_]+)/""", 1)
    hosts = F.create_map(*[F.lit(x) for kv in MODEL_HOSTS.items() for x in kv])
    return out.withColumn("destination", F.when(network, F.col("destination")).when(F.col("sink_rule") == "source.llm_api_call", hosts[prefix]))


def flow_cap(flows: DataFrame, most: int = 12) -> DataFrame:
    """The first flows of each target, the surest first, ties as they are met in the file, and how many are hidden."""
    w = Window.partitionBy("target", "version").orderBy(F.desc(confidence_rank(F.col("confidence"))), "source", "sink", "path", "source_seen", "sink_seen")
    counts = flows.groupBy("target", "version").agg(F.greatest(F.lit(0), F.count("*") - most).alias("n_hidden"))
    return flows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).join(counts, ["target", "version"])


def dataflow_findings(flows: DataFrame) -> DataFrame:
    """One finding for each outbound flow from a sensitive source; a provider's own key is LOW (provider_scope)."""
    worth = F.create_map(*[F.lit(x) for k, v in EXFIL_WORTHY.items() for x in (k, v[0])])
    subject = F.create_map(*[F.lit(x) for k, v in EXFIL_WORTHY.items() for x in (k, v[1])])
    rows = flows.where(F.col("sink").isin(*OUTBOUND) & F.col("source").isin(*EXFIL_WORTHY))
    scoped = F.col("provider_scope").isNotNull() & (F.col("source") == "environment.read") if "provider_scope" in flows.columns else F.lit(False)
    proof = F.array(evidence(F.col("path"), F.col("source_line"), snippet(F.col("source_text")), F.lit("source")), evidence(F.col("path"), F.col("sink_line"), snippet(F.col("sink_text")), F.lit("sink")))
    title = F.when(scoped, "A service's own key close to a call of that service").otherwise(F.concat(F.lit("Close to a way out: "), subject[F.col("source")]))
    return rows.select("target", "version", *finding(F.concat(F.lit("dataflow."), "source", F.lit("__"), "sink"), "NETWORK", F.when(scoped, "LOW").otherwise(worth[F.col("source")]), F.when(scoped, "LOW").otherwise(F.col("confidence")), title, proof))
