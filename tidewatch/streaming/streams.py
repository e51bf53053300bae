"""The same operators on streams of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions.catalogue import CATALOGUE, Rule
from tidewatch.operators.matches import match_rules


def stream_matches(lines: DataFrame, rules: tuple[Rule, ...] = CATALOGUE) -> DataFrame:
    """Matches of arriving lines: the batch projection, without state. More columns of lines, as a time, are carried along."""
    own = {"target", "version", "path", "line", "text"}
    return match_rules(lines, rules, tuple(c for c in lines.columns if c not in own))


def stream_capability_gain(matches: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """First sight of each capability of a target within the watermark; later rows and late rows are dropped."""
    rows = matches.where("capability is not null").select("target", "capability", time)
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(["target", "capability"])


class FirstSight(StatefulProcessor):
    """State of one (target, capability): when it was first seen. Rows of a key that has state give nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.seen.exists():
            return
        times = [r["at"] for r in rows if r["at"] is not None]
        first = min(times) if times else None
        self.seen.update((first,))
        yield Row(target=key[0], capability=key[1], first_seen=first)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        if not self.seen.exists():
            self.seen.update((initialState["at"],))


def stream_new_capabilities(matches: DataFrame, accepted: DataFrame | None = None, time: str = "ts") -> DataFrame:
    """(target, capability, first_seen): the first sight of each capability of a target, exact over all time.

    accepted (target, capability, and first_seen if it is known) is what the stream begins with; it is read into the state once,
    by the first batch, and never again. The state has a row for each target and capability. first_seen is the earliest time
    of the batch that brings the capability: a row that comes later, however old, changes nothing. Repeated rows and
    a restart from the checkpoint add nothing; rows without a target or capability are no sight.
    """
    spark = matches.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keys = ["target", "capability"]
    rows = matches.where("target is not null and capability is not null").select(*keys, F.col(time).cast("timestamp").alias("at"))
    begin = None
    if accepted is not None:
        at = F.col("first_seen").cast("timestamp") if "first_seen" in accepted.columns else F.lit(None).cast("timestamp")
        begin = accepted.where("target is not null and capability is not null").groupBy(*keys).agg(F.min(at).alias("at")).groupBy(*keys)
    return rows.groupBy(*keys).transformWithState(FirstSight(), "target string, capability string, first_seen timestamp", "Append", "None", initialState=begin)


def merge_baseline(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends what the table at path has not seen yet: exact over all time.

    A batch that runs again adds nothing twice, as its rows are then in the table.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.select("target", "capability").distinct()
        try:
            known = spark.read.parquet(path)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        if known is not None:
            new = new.join(known.select("target", "capability"), ["target", "capability"], "left_anti")
        new.write.mode("append").parquet(path)

    return merge


def first_seen(events: DataFrame) -> DataFrame:
    """Batch twin of the stream: (target, capability, first_seen)."""
    return events.where("capability is not null").groupBy("target", "capability").agg(F.min("ts").alias("first_seen"))
