"""Work queues and review state folded from event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.operators.ordered import CHUNK_ROWS, measured_chunks, running

# Days until a detail page is captured again.
SUCCESS_COOLDOWN_DAYS = 7
FAILURE_COOLDOWN_DAYS = 1


def capture_cooldown(attempts: DataFrame, details: DataFrame, now: Column, restarted_at: Column | None = None) -> DataFrame:
    """Capture state per listing from a log of attempts (listing_id, state, at, error_code).

    With ``restarted_at``, an attempt still processing then has failed as interrupted.
    """
    last = attempts.groupBy("listing_id").agg(F.max(F.struct("at", "state", "error_code")).alias("r"))
    state, at = F.col("r.state"), F.col("r.at")
    cut = (state == "processing") if restarted_at is not None else F.lit(False)
    state_ = F.when(cut, F.lit("failed")).otherwise(state)
    done = F.when(cut, restarted_at if restarted_at is not None else at).otherwise(at)
    rows = last.select(
        "listing_id",
        state_.alias("state"),
        F.when(cut, F.lit("interrupted")).otherwise(F.col("r.error_code")).alias("last_error_code"),
        F.when(state_ == "succeeded", done + F.expr(f"INTERVAL {SUCCESS_COOLDOWN_DAYS} DAYS"))
        .when(state_ == "failed", done + F.expr(f"INTERVAL {FAILURE_COOLDOWN_DAYS} DAYS"))
        .otherwise(done)
        .alias("next_attempt_at"),
    )
    joined = rows.join(details.select("listing_id", "captured_at"), "listing_id", "full")
    stale = F.col("captured_at").isNull() | (
        F.unix_micros(now) - F.unix_micros("captured_at") >= F.lit(7 * 86_400_000_000)
    )
    return joined.withColumns(
        {
            "stale": stale,
            "can_capture": stale
            & (F.col("state").isNull() | ((F.col("state") != "processing") & (F.col("next_attempt_at") <= now))),
            "state": F.coalesce("state", F.lit("not_captured")),
        }
    )


def circuit_breaker(log: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Pause episodes from a log of control rows (at, kind pause|resume, seq).

    Only the first pause of an episode opens it; the next resume closes it. One control switch
    has one log, which is cut into chunks of ``chunk_rows``, so that it is not sorted in one task,
    however many rows a day has.
    """
    one = measured_chunks(log.withColumn("_switch", F.lit(1)), ["_switch"], ["at", "seq"], chunk_rows)
    chunk = F.col("_part")
    paused = F.col("kind") == "pause"
    previous = running(one, ["_switch"], chunk, ["at", "seq"], {"_before": ("last", F.col("kind"))}, inclusive=False)
    opens = previous.filter(paused & (F.col("_before").isNull() | (F.col("_before") != "pause")))
    closes = previous.filter(~paused & (F.col("_before") == "pause"))
    numbered = running(opens, ["_switch"], chunk, ["at", "seq"], {"generation": ("sum", F.lit(1))})
    ended = running(closes, ["_switch"], chunk, ["at", "seq"], {"generation": ("sum", F.lit(1))})
    return numbered.select("generation", F.col("at").alias("paused_at")).join(
        ended.select("generation", F.col("at").alias("resumed_at")), "generation", "left"
    )


def review_state(log: DataFrame) -> DataFrame:
    """Latest review per listing: state, reason (only when rejected), archived.

    ``log``: listing_id, at, seq, kind (state | archive), state, reason, archived.
    """
    when = F.struct("at", "seq")
    decided = F.max(F.when(F.col("kind") == "state", F.struct(when.alias("w"), "state", "reason")))
    filed = F.max(F.when(F.col("kind") == "archive", F.struct(when.alias("w"), "archived")))
    return log.groupBy("listing_id").agg(decided.alias("s"), filed.alias("a"), F.max("at").alias("updated_at")).select(
        "listing_id",
        F.coalesce("s.state", F.lit("new")).alias("state"),
        F.when(F.col("s.state") == "rejected", F.nullif(F.trim("s.reason"), F.lit(""))).alias("rejection_reason"),
        F.coalesce("a.archived", F.lit(False)).alias("archived"),
        "updated_at",
    )


def queue_recovery(queue: DataFrame, excluded: DataFrame, at: Column) -> DataFrame:
    """After a restart: interrupted work is queued again, work on excluded listings is cancelled."""
    marked = queue.join(excluded.select("listing_id", F.lit(True).alias("_out")), "listing_id", "left")
    out = F.coalesce("_out", F.lit(False))
    hit = F.col("state") == "processing"
    waiting = F.col("state").isin("queued", "failed") & out
    return marked.withColumns(
        {
            "last_error_code": F.when((hit & out) | waiting, F.lit("excluded_by_classifier"))
            .when(hit, F.lit("interrupted"))
            .otherwise(F.col("last_error_code")),
            "available_at": F.when(hit, at).otherwise(F.col("available_at")),
            "state": F.when((hit & out) | waiting, F.lit("cancelled")).when(hit, F.lit("queued")).otherwise(F.col("state")),
        }
    ).drop("_out")


# Seconds until a failed request is tried again, by kind of failure.
RETRY_SECONDS = {"rate_limited": 60, "timeout": 15, "upstream_failure": 30}


def retry_at(failure: Column, completed_at: Column) -> Column:
    """When a failed request is tried again; null for failures that are not retried."""
    delays = F.create_map(*[F.lit(v) for pair in RETRY_SECONDS.items() for v in pair])
    seconds = F.try_element_at(delays, failure)
    return F.timestamp_micros(F.unix_micros(completed_at) + seconds * 1_000_000)


_QUEUE_ITEM = (
    "struct<state:string,version:bigint,requested_at:timestamp,available_at:timestamp,started_at:timestamp,completed_at:timestamp,"
    "attempts:bigint,last_error_code:string,claimed:bigint,excluded:boolean>"
)


def enrichment_queue(log: DataFrame) -> DataFrame:
    """State of each listing's work from its log, folded in order of time.

    ``log``: listing_id, at, seq, kind, version (of the facts asked about), failure. Kinds:
    ``enqueue`` asks for a version (the same one again changes nothing, unless it was cancelled; a
    newer one waits for running work), ``claim`` starts waiting work that is due, ``success`` and
    ``failure`` end it (for an older version than the one asked for, the work waits again),
    ``exclude`` cancels unfinished work and holds until ``include``. A listing never asked about has
    no row. A listing's log meets in one row, as each step needs the one before.
    """
    steps = log.groupBy("listing_id").agg(F.sort_array(F.collect_list(F.struct("at", "seq", "kind", "version", "failure"))).alias("steps"))

    def step(s: Column, e: Column) -> Column:
        kind, fresh = e["kind"], s["state"].isNull()
        same = s["version"].eqNullSafe(e["version"]) & ~fresh
        kept = same & (s["state"] != "cancelled")
        running_, current = s["state"] == "processing", s["version"].eqNullSafe(s["claimed"])
        due = (s["state"] == "queued") & (s["available_at"] <= e["at"])
        again = retry_at(e["failure"], e["at"])
        none = F.lit(None)

        def item(**changed: Column) -> Column:
            names = [part.split(":")[0] for part in _QUEUE_ITEM[7:-1].split(",")]
            return F.struct(*[changed.get(n, s[n]).alias(n) for n in names]).cast(_QUEUE_ITEM)

        asked = item(
            state=F.when(fresh, F.lit("queued")).when(kept, s["state"]).when(~same & running_, s["state"]).otherwise(F.lit("queued")),
            version=e["version"],
            requested_at=F.when(kept, s["requested_at"]).otherwise(e["at"]),
            available_at=F.when(kept, s["available_at"]).otherwise(e["at"]),
            completed_at=F.when(kept, s["completed_at"]),
            last_error_code=F.when(kept, s["last_error_code"]),
            attempts=F.coalesce(s["attempts"], F.lit(0)),
        )
        claimed = item(state=F.lit("processing"), started_at=e["at"], attempts=s["attempts"] + 1, claimed=s["version"])
        done = item(
            state=F.when(current, F.lit("completed")).otherwise(F.lit("queued")),
            available_at=e["at"], started_at=none, completed_at=F.when(current, e["at"]), last_error_code=none,
        )
        failed = item(
            state=F.when(current & again.isNull(), F.lit("failed")).otherwise(F.lit("queued")),
            available_at=F.when(current, F.coalesce(again, e["at"])).otherwise(e["at"]),
            started_at=none, completed_at=none, last_error_code=e["failure"],
        )
        open_ = s["state"].isin("queued", "processing", "failed")
        out = F.when(
            open_, item(state=F.lit("cancelled"), started_at=none, completed_at=none, last_error_code=F.lit("excluded_by_classifier"), excluded=F.lit(True))
        ).otherwise(item(excluded=F.lit(True)))
        return (
            F.when((kind == "enqueue") & ~s["excluded"], asked)
            .when((kind == "claim") & due, claimed)
            .when((kind == "success") & running_, done)
            .when((kind == "failure") & running_, failed)
            .when(kind == "exclude", out)
            .when(kind == "include", item(excluded=F.lit(False)))
            .otherwise(s)
        )

    zero = F.struct(
        *[F.lit(False if part.startswith("excluded") else None).alias(part.split(":")[0]) for part in _QUEUE_ITEM[7:-1].split(",")]
    ).cast(_QUEUE_ITEM)
    folded = steps.select("listing_id", F.aggregate("steps", zero, step).alias("q")).filter(F.col("q.state").isNotNull())
    return folded.select("listing_id", "q.*").drop("claimed", "excluded")
