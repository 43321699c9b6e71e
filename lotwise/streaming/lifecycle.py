"""Listing lifecycle over streams: one small state per listing, kept by Spark's state store.

A micro-batch touches only the states of the listings it brings rows for, and of those whose timer
runs out. Every change is appended to a log of changes, one folder per batch, so a batch that runs
again after a failure replaces its own output and nothing else; the current states are the latest
change of each listing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from lotwise.operators.history import INACTIVE_AFTER_SECONDS, MISSES_UNTIL_DOUBTFUL, STATE, latest_per_key

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY = INACTIVE_AFTER_SECONDS * 1_000_000
_FIELDS = ["first_seen_at", "last_seen_at", "consecutive_misses", "possibly_unavailable_at", "inactive_at", "sold_at", "changes"]


def step(state: list | None, at: int, kind: str, timers: bool) -> list | None:
    """State after one row; times are microseconds, the state is in the order of ``_FIELDS``.

    With ``timers`` a doubtful listing becomes inactive at the moment its day is over; without, at the
    first miss or sweep after that.
    """
    if state is None:
        return [at, at, 0, None, None, None, 0] if kind == "seen" else None
    first, last, misses, doubt, gone, sold, changes = state
    if timers:
        gone = _expired(state, at)
    if kind == "sold":
        return [first, last, misses, doubt, gone, at, changes]
    if kind == "seen":
        span = [min(first, at), max(last, at)]
        return [*span, misses, doubt, gone, sold, changes] if sold is not None else [*span, 0, None, None, None, changes]
    if sold is None:
        if kind == "miss" and at > last:
            misses += 1
            if misses >= MISSES_UNTIL_DOUBTFUL and doubt is None:
                doubt = at
        if (kind == "sweep" or at > last) and misses >= MISSES_UNTIL_DOUBTFUL and at - last >= _DAY and gone is None:
            gone = at
    return [first, last, misses, doubt, gone, sold, changes]


def _in_order(row: Row, order: list[str]) -> tuple:
    """Place of a row in its log; what is unknown comes last."""
    return row["at"], *[(row[c] is None or row[c] != row[c], row[c]) for c in order]


def _due(state: list) -> int | None:
    """When a doubtful listing becomes inactive of itself."""
    _, last, misses, doubt, gone, sold, _ = state
    if sold is not None or gone is not None or misses < MISSES_UNTIL_DOUBTFUL:
        return None
    return max(last + _DAY, doubt)


def _expired(state: list, now: int) -> int | None:
    due = _due(state)
    return due if due is not None and due <= now else state[4]


class Lifecycle(StatefulProcessor):
    """Folds the rows of a listing into its state, in the order of their columns after ``kind``."""

    def __init__(self, key: str, order: list[str], timers: bool) -> None:
        self.key, self.order, self.timers = key, order, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("lifecycle", StructType([StructField(f, LongType()) for f in _FIELDS]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.held.get()
        state = None if held is None else list(held)
        # A micro-batch's rows of one listing, which the source's limits bound.
        for row in sorted(rows, key=lambda r: _in_order(r, self.order)):
            state = step(state, row["at"], row["kind"], self.timers)
        if state is None:
            return
        state[-1] += 1
        self._keep(state)
        yield self._row(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = list(self.held.get())
        gone = _expired(state, expiredTimerInfo.getExpiryTimeInMs() * 1000)
        if gone is not None and state[4] is None:
            state[4] = gone
            state[-1] += 1
            self.held.update(tuple(state))
            yield self._row(key, state)

    def _keep(self, state: list) -> None:
        self.held.update(tuple(state))
        if not self.timers:
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        due = _due(state)
        if due is not None:
            self.handle.registerTimer(-(-due // 1000))

    def _row(self, key, state: list) -> Row:
        return Row(**{self.key: key[0], **dict(zip(_FIELDS, state))})

    def close(self) -> None:
        pass


def lifecycle_changes(stream: DataFrame, key: str, at: str, kind: str, order: list[str], timers: bool = False, late: str = "0 seconds") -> DataFrame:
    """Stream of the changed states. ``order`` starts with ``at``. With ``timers``, rows may come
    ``late`` after others before a day without a sighting counts as over."""
    if order[0] != at:
        raise ValueError("the order of a lifecycle log starts with its time")
    rest = [f"o{i}" for i in range(len(order) - 1)]
    rows = stream.select(
        F.col(key), F.col(kind).alias("kind"), F.unix_micros(at).alias("at"), F.col(at).alias("event_time"), *[F.col(c).alias(n) for c, n in zip(order[1:], rest)]
    ).filter(F.col(key).isNotNull() & F.col("at").isNotNull())
    if timers:
        rows = rows.withWatermark("event_time", late)
    schema = StructType([StructField(key, stream.schema[key].dataType), *[StructField(f, LongType()) for f in _FIELDS]])
    folded = rows.groupBy(key).transformWithState(Lifecycle(key, rest, timers), schema, "Update", "EventTime" if timers else "None")
    return folded.withColumns({f: F.timestamp_micros(f) for f in _FIELDS if f.endswith("_at")})


def run_lifecycle(
    stream: DataFrame, root: str, checkpoint: str, key: str, at: str, kind: str, order: list[str], timers: bool = False, late: str = "0 seconds"
) -> DataFrame:
    """Work off all rows now available and return the resulting states.

    ``root`` gets the log of changes; a later call with the same folders goes on where the last ended.
    """
    spark = stream.sparkSession
    changes = lifecycle_changes(stream, key, at, kind, order, timers, late)

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)  # the store that keeps timers; a query takes it over when it starts
    try:
        query = changes.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return current_states(spark, root, key, changes.schema)


def current_states(spark: SparkSession, root: str, key: str, schema: StructType) -> DataFrame:
    """Latest change of each listing, with its availability."""
    log = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(root)
    availability = (
        F.when(F.col("sold_at").isNotNull(), F.lit("sold"))
        .when(F.col("inactive_at").isNotNull(), F.lit("inactive"))
        .when(F.col("possibly_unavailable_at").isNotNull(), F.lit("possibly_unavailable"))
        .otherwise(F.lit("active"))
    )
    return latest_per_key(log, [key], ["changes"], STATE).select(key, availability.alias("availability"), *STATE)


def dedupe_stream(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Drop replayed rows that come within ``late`` of each other."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
