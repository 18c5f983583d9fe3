"""The latest version of each document, kept up to date by a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.catalog import version_key

#: latest: this version is now the document's latest. taken back: it was, and is no more. dropped: it came behind a later
#: one; n counts those of the document. forgotten: nothing has come for so long that the document left the state.
CHANGES = "doc string, version string, change string, n bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestVersions(StatefulProcessor):
    """For each document its latest version and the number of those that came too late, in one value of the state, as each
    access costs a call; with an event time, a timer that forgets the document `keep_ms` after its last arrival."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "version string, numbers array<bigint>, rests array<string>, late bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        order = lambda version, numbers, rests: (list(zip(numbers, rests)), version)
        known = self.kept.get()  # None without one
        best, late = (order(*known[:3]), known[3]) if known else (None, 0)
        seen, before, arrived = best, late, None
        for row in rows:
            arrived = max(arrived or 0, row["at_ms"] or 0)
            found = order(row["version"], row["numbers"], row["rests"])
            if best is None or found > best:
                best = found
            elif found != best:
                late += 1
                yield Row(doc=key[0], version=row["version"], change="dropped", n=late)
        if best != seen:  # versions of one batch that overtake one another are told by the last only
            if seen is not None:
                yield Row(doc=key[0], version=seen[1], change="taken back", n=late)
            yield Row(doc=key[0], version=best[1], change="latest", n=late)
        if best != seen or late != before:
            self.kept.update((best[1], [n for n, _ in best[0]], [r for _, r in best[0]], late))
        if self.keep_ms is not None and arrived is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(arrived + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if known := self.kept.get():
            yield Row(doc=key[0], version=known[0], change="forgotten", n=known[3])
        self.kept.clear()

    def close(self) -> None:
        pass


def changes(stream: DataFrame, doc: str, version: Column, at: str | None = None, late: str = "1 day", keep_ms: int | None = None) -> DataFrame:
    """The changes (CHANGES) of each document's latest version. at: the event time; without it nothing is ever forgotten.

    Rows may come in any order and in any batches: what is the latest in the end does not depend on it. Null documents are
    one document, null versions are left out. A forgotten document begins anew if something comes for it later. Needs
    RocksDB as the state store, which start() sets.
    """
    rows = stream.withWatermark(at, late) if at else stream
    when = F.unix_millis(F.col(at).cast("timestamp")) if at else F.lit(0).cast("bigint")
    kept = rows.select(F.col(doc).cast("string").alias("doc"), version.cast("string").alias("version"), when.alias("at_ms"), *([F.col(at)] if at else [])).where("version is not null")
    key = version_key(F.col("version"))
    kept = kept.withColumns({"numbers": key["number"], "rests": key["rest"]})
    timers = at is not None and keep_ms is not None
    return kept.groupBy("doc").transformWithState(LatestVersions(keep_ms if timers else None), CHANGES, "Append", "EventTime" if timers else "None")


def start(changed: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write the changes, a folder a batch, so that a batch that runs again replaces what it wrote."""
    spark = changed.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return changed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(changed: DataFrame) -> DataFrame:
    """(doc, version) of the documents in the table of changes, as they are after its last batch; forgotten ones, too, keep
    the version that they had."""
    step = F.when(F.col("change") == "latest", 1).when(F.col("change") == "taken back", -1).otherwise(0)
    held = changed.where(step != 0).groupBy("doc", "version").agg(F.sum(step).alias("_n"), F.max("batch").alias("_b")).where("_n > 0")
    return held.groupBy("doc").agg(F.max_by("version", F.struct("_b", version_key(F.col("version")), "version")).alias("version"))
