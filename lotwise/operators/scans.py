"""Scan logs: stop points, page collection, progress streaks, reports and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.operators.ordered import block_of, running

# Limits of a scan.
INITIAL_CARD_LIMIT = 300
KNOWN_STREAK_LIMIT = 50
CARD_LIMIT = 1_000
PAGE_LIMIT = 15
LISTING_LIMIT = 800
EMPTY_PAGES = 2
EMPTY_SNAPSHOTS = 3
MIN_CARDS_FOR_TOLERANCE = 10
MAX_REJECTED_RATIO = 0.1
INTERVAL_MINUTES = 15
INTERVAL_MAX_MINUTES = 30


def known_streak(df: DataFrame, scan: list[str], position: str, known: Column) -> DataFrame:
    """Add cards_seen (running count) and streak (known cards in a row, up to this card)."""
    df = df.withColumn("_known", known.cast("boolean"))
    counted = running(df, scan, block_of(position), [position], {"cards_seen": ("sum", F.lit(1))})
    broken = running(
        counted,
        scan,
        block_of(position),
        [position],
        {"_last_new": ("max", F.when(~F.col("_known"), F.col("cards_seen")))},
    )
    return broken.withColumn("streak", F.col("cards_seen") - F.coalesce("_last_new", F.lit(0))).drop("_last_new", "_known")


def scan_stop_point(
    df: DataFrame,
    scan: list[str],
    position: str,
    known: Column,
    initial: Column,
    mode: Column | None = None,
    initial_limit: int = INITIAL_CARD_LIMIT,
    streak_limit: int = KNOWN_STREAK_LIMIT,
    card_limit: int = CARD_LIMIT,
    existing: Column | None = None,
    card: str | None = None,
    snapshot: str | None = None,
    empty_limit: int = EMPTY_SNAPSHOTS,
) -> DataFrame:
    """One row per scan: where it stops, why, and how many cards and new cards it keeps.

    ``known`` says that this search saw the card before and makes the streak; ``existing`` (``known``
    if not given) that any search did, and all others count as new. With ``card``, a card shown again
    in the scan counts only once. With ``snapshot`` (rising along ``position``), a scan also stops
    after ``empty_limit`` snapshots in a row that show no further card.
    """
    standard = F.lit(True) if mode is None else mode == "standard"
    df = df.withColumns({"_k": known, "_e": known if existing is None else existing, "_i": initial, "_s": standard})
    once = df
    if card is not None:
        first = df.groupBy(*scan, card).agg(F.min(position).alias(position))
        once = df.join(first, [*scan, card, position], "left_semi")
    if snapshot is not None:
        added = once.groupBy(*scan, snapshot).agg(F.count("*").alias("_added"))
        shots = df.select(*scan, snapshot).distinct().join(added, [*scan, snapshot], "left").withColumn("_added", F.coalesce("_added", F.lit(0)))
        stalled = no_progress_streak(shots, scan, snapshot, "_added", empty_limit).filter("stalled")
        stalled = stalled.groupBy(*scan).agg(F.min(snapshot).alias("_stall"))
        once = once.join(stalled, scan, "left").filter(F.col("_stall").isNull() | (F.col(snapshot) <= F.col("_stall")))
    else:
        once = once.withColumn("_stall", F.lit(None).cast("bigint"))
    walked = known_streak(once, scan, position, F.col("_k"))
    reason = (
        F.when(F.col("_s") & F.col("_i") & (F.col("cards_seen") >= initial_limit), F.lit("initial_limit"))
        .when(F.col("_s") & ~F.col("_i") & (F.col("streak") >= streak_limit), F.lit("known_streak"))
        .when(F.col("cards_seen") >= card_limit, F.lit("card_limit"))
    )
    walked = walked.withColumn("_reason", reason)
    stops = walked.groupBy(*scan).agg(
        F.min(F.when(F.col("_reason").isNotNull(), F.struct(F.col("cards_seen").alias("at"), F.col("_reason").alias("why")))).alias("stop")
    )
    kept = walked.join(stops, scan).filter(F.col("stop").isNull() | (F.col("cards_seen") <= F.col("stop.at")))
    return kept.groupBy(*scan).agg(
        F.count("*").alias("cards_seen"),
        F.count_if(~F.col("_e")).alias("new_cards"),
        F.coalesce(
            F.first("stop.why"), F.when(F.max("_stall").isNotNull(), F.lit("no_progress")).otherwise(F.lit("results_end"))
        ).alias("stop_reason"),
    )


def no_progress_streak(pages: DataFrame, scan: list[str], page: str, added: str, limit: int = EMPTY_PAGES) -> DataFrame:
    """Add empty_streak: pages in a row that brought nothing new; and stalled at the limit."""
    numbered = running(pages, scan, block_of(page), [page], {"_n": ("sum", F.lit(1))})
    last = running(numbered, scan, block_of(page), [page], {"_last": ("max", F.when(F.col(added) > 0, F.col("_n")))})
    return last.withColumn("empty_streak", F.col("_n") - F.coalesce("_last", F.lit(0))).withColumn(
        "stalled", F.col("empty_streak") >= limit
    ).drop("_n", "_last")


def collect_pages(
    cards: DataFrame,
    scan: list[str],
    page: str,
    position: str,
    listing: str,
    limit: int = LISTING_LIMIT,
    page_limit: int = PAGE_LIMIT,
    empty_pages: int = EMPTY_PAGES,
    errors: DataFrame | None = None,
) -> DataFrame:
    """Newest-first collection of numbered pages: one row per scan.

    The first sighting of a listing counts. Collection stops at the listing limit, after
    ``empty_pages`` pages without a new listing, at the page limit or at a failed page. ``errors``
    lists failed pages (scan, page, error); an empty page ends the results.
    """
    inside = cards.filter(F.col(page) <= page_limit)
    if errors is not None:
        bad = errors.groupBy(*scan).agg(F.min(F.struct(page, "error")).alias("_bad"))
        inside = inside.join(bad, scan, "left").filter(F.col("_bad").isNull() | (F.col(page) < F.col(f"_bad.{page}")))
    place = F.struct(F.col(page).alias("p"), F.col(position).alias("c"))
    firsts = inside.groupBy(*scan, listing).agg(F.min(place).alias("place"))
    added = firsts.groupBy(*scan, F.col("place.p").alias(page)).agg(F.count("*").alias("added"))
    per_page = inside.groupBy(*scan, page).agg(F.count("*").alias("cards")).join(added, [*scan, page], "left")
    per_page = per_page.fillna(0, ["added"])
    walked = no_progress_streak(per_page, scan, page, "added", empty_pages)
    walked = running(walked, scan, block_of(page), [page], {"collected": ("sum", F.col("added"))})
    full, stalled = F.col("collected") >= limit, F.col("stalled")
    stops = walked.groupBy(*scan).agg(
        F.min(F.when(full, F.struct(F.col(page), F.lit("listing_limit").alias("why")))).alias("full"),
        F.min(F.when(stalled, F.struct(F.col(page), F.lit("no_progress").alias("why")))).alias("stall"),
        F.max(page).alias("last_page"),
    )
    stops = stops.select(
        *scan,
        F.least(F.col("full"), F.col("stall")).alias("stop"),
        "last_page",
    )
    kept = walked.join(stops, scan).filter(F.col("stop").isNull() | (F.col(page) <= F.col(f"stop.{page}")))
    ended = F.when(F.first("last_page") >= page_limit, F.lit("page_limit")).otherwise(F.lit("results_end"))
    out = kept.groupBy(*scan).agg(
        F.count("*").alias("pages_scanned"),
        F.sum("cards").alias("recognized_cards"),
        F.least(F.max("collected"), F.lit(limit)).alias("listings"),
        F.coalesce(F.first(F.col("stop.why")), ended).alias("stop_reason"),
    )
    if errors is not None:
        out = out.join(bad, scan, "left").withColumns(
            {
                "partial_error": F.when(~F.col("stop_reason").isin("listing_limit", "no_progress"), F.col("_bad.error")),
                "stop_reason": F.when(
                    F.col("_bad").isNotNull() & ~F.col("stop_reason").isin("listing_limit", "no_progress"),
                    F.lit("request_error"),
                ).otherwise(F.col("stop_reason")),
            }
        ).drop("_bad")
    return out


def rejected_ratio_gate(cards: DataFrame, scan: list[str], rejected: Column) -> DataFrame:
    """Add unsafe: any rejected card in a small scan, or more than a tenth in a larger one."""
    counts = cards.groupBy(*scan).agg(F.count("*").alias("cards"), F.count_if(rejected).alias("rejected"))
    small = F.col("cards") < MIN_CARDS_FOR_TOLERANCE
    unsafe = (F.col("rejected") > 0) & (small | (F.col("rejected") / F.col("cards") > MAX_REJECTED_RATIO))
    return counts.withColumn("unsafe", unsafe)


def scan_report(cards: DataFrame, scan: list[str], **flags: Column) -> DataFrame:
    """Counts per scan: collected and one count per named condition."""
    return cards.groupBy(*scan).agg(
        F.count("*").alias("collected"), *[F.count_if(cond).alias(name) for name, cond in flags.items()]
    )


def missing_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """Add missing_fields: names of the null columns, in the given order."""
    return df.withColumn(
        "missing_fields", F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))
    )


def probe_report(df: DataFrame, by: list[str], fields: list[str], price: str, budget_eur: int) -> DataFrame:
    """Sample summary: rows, rows with a gap, null count per field, rows inside the budget."""
    inside = F.coalesce(F.col(price) <= budget_eur * 100, F.lit(False))
    gap = F.exists(F.array(*[F.col(f).isNull() for f in fields]), lambda x: x)
    return df.groupBy(*by).agg(
        F.count("*").alias("listings"),
        F.count_if(gap).alias("with_gaps"),
        *[F.count_if(F.col(f).isNull()).alias(f"missing_{f}") for f in fields],
        F.count_if(inside).alias("eligible"),
        F.count_if(~inside).alias("ineligible"),
    )


def scan_success_state(runs: DataFrame, search: str, at: str, error: str) -> DataFrame:
    """Last attempt, last attempt without error, and the error of the last attempt."""
    latest = F.max(F.struct(F.col(at), F.col(error).alias("e")))
    return runs.groupBy(search).agg(
        F.max(at).alias("last_attempt_at"),
        F.max(F.when(F.col(error).isNull(), F.col(at))).alias("last_success_at"),
        latest["e"].alias("last_error"),
    )


def trailing_failures(runs: DataFrame, search: str, order: str, failed: Column) -> DataFrame:
    """Failures after the last success, with the last completion time."""
    marked = runs.withColumn("_f", failed)
    last_ok = marked.groupBy(search).agg(F.max(F.when(~F.col("_f"), F.col(order))).alias("_ok"), F.max(order).alias("last_scan_at"))
    return (
        marked.join(last_ok, search)
        .groupBy(search)
        .agg(
            F.count_if(F.col("_f") & (F.col("_ok").isNull() | (F.col(order) > F.col("_ok")))).alias("failures"),
            F.max("last_scan_at").alias("last_scan_at"),
        )
    )


def schedule_next(df: DataFrame, at: str, priority: Column, failures: Column, random: Column) -> DataFrame:
    """Add next_scan_at: 15 to 30 minutes, later for low priority, times up to 4 after failures."""
    spread = F.least(F.lit(1.0), F.greatest(F.lit(0.0), random)) * (INTERVAL_MAX_MINUTES - INTERVAL_MINUTES)
    minutes = F.least(
        F.lit(float(INTERVAL_MAX_MINUTES)),
        F.lit(float(INTERVAL_MINUTES)) + spread + F.greatest(F.lit(0), priority - 1) * 0.5,
    )
    backoff = F.when(failures == 0, F.lit(1.0)).otherwise(F.least(F.lit(4.0), F.pow(F.lit(2.0), failures)))
    # Milliseconds are cut, as a clock with millisecond steps does.
    millis = F.floor(minutes * backoff * 60_000).cast("bigint")
    return df.withColumn("next_scan_at", F.timestamp_millis(F.unix_millis(F.col(at)) + millis))


def due_list(schedule: DataFrame, now: Column) -> DataFrame:
    return schedule.filter(F.col("next_scan_at") <= now).orderBy("next_scan_at", "search_id")


def min_due(schedule: DataFrame) -> DataFrame:
    return schedule.agg(F.min("next_scan_at").alias("next_scan_at"))


def queue_by_priority(runs: DataFrame, searches: DataFrame) -> DataFrame:
    """Queued runs by search priority, request time and id; runs of unknown searches come last."""
    return (
        runs.filter(F.col("state") == "queued")
        .join(searches.select("search_id", "priority"), "search_id", "left")
        .orderBy(F.col("priority").asc_nulls_last(), "requested_at", "run_id")
    )


def scan_run_states(log: DataFrame) -> DataFrame:
    """Latest state of each run: run_id, search_id, mode, state, at."""
    row = F.struct("at", "seq", "search_id", "state")
    deep = F.max(F.when(F.col("mode") == "deep", 1).otherwise(0))
    return log.groupBy("run_id").agg(F.max(row).alias("r"), deep.alias("deep")).select(
        "run_id",
        F.col("r.search_id").alias("search_id"),
        F.col("r.state").alias("state"),
        F.when(F.col("deep") == 1, F.lit("deep")).otherwise(F.lit("standard")).alias("mode"),
        F.col("r.at").alias("at"),
    )


def requeue_interrupted(runs: DataFrame) -> DataFrame:
    """After a restart: running runs are queued again, or fail where another run is queued.

    A queued run takes over the deep mode of the running one it replaces.
    """
    per_search = runs.groupBy("search_id").agg(
        F.max((F.col("state") == "queued").cast("int")).alias("_queued"),
        F.max(((F.col("state") == "running") & (F.col("mode") == "deep")).cast("int")).alias("_deep"),
    )
    joined = runs.join(per_search, "search_id")
    running_ = F.col("state") == "running"
    superseded = running_ & (F.col("_queued") == 1)
    return joined.withColumns(
        {
            "mode": F.when((F.col("state") == "queued") & (F.col("_deep") == 1), F.lit("deep")).otherwise(F.col("mode")),
            "error_code": F.when(superseded, F.lit("INTERRUPTED")),
            "state": F.when(superseded, F.lit("failed")).when(running_, F.lit("queued")).otherwise(F.col("state")),
        }
    ).drop("_queued", "_deep")


def eligible_searches(searches: DataFrame, verifications: DataFrame, blocked: DataFrame) -> DataFrame:
    """Active, targeted searches, verified with their current criteria, on no paused scope."""
    return (
        searches.filter(F.col("active") & (F.coalesce(F.col("scope"), F.lit("targeted")) != "broad"))
        .join(verifications.select("search_id", "fingerprint"), ["search_id", "fingerprint"], "left_semi")
        .join(blocked.select("search_id"), "search_id", "left_anti")
    )


def verification_state(searches: DataFrame, verifications: DataFrame) -> DataFrame:
    """Add verification: unverified, verified, or stale when the criteria changed since."""
    seen = verifications.select("search_id", F.col("fingerprint").alias("_seen"), "verified_at")
    joined = searches.join(seen, "search_id", "left")
    broad = F.coalesce(F.col("scope"), F.lit("targeted")) == "broad"
    return joined.withColumns(
        {
            "verification": F.when(broad | F.col("_seen").isNull(), F.lit("unverified"))
            .when(F.col("_seen") == F.col("fingerprint"), F.lit("verified"))
            .otherwise(F.lit("stale")),
            "verified_at": F.when(~broad, F.col("verified_at")),
        }
    ).drop("_seen")


def pause_state(log: DataFrame) -> DataFrame:
    """Active pause per scope from a log of pause and resolve rows: the last pause since a resolve."""
    row = F.struct("at", "seq", "kind", "failure_kind", "detail")
    return (
        log.groupBy("scope", "scope_key")
        .agg(F.max(row).alias("r"))
        .filter(F.col("r.kind") == "pause")
        .select("scope", "scope_key", F.col("r.failure_kind").alias("failure_kind"), F.col("r.at").alias("paused_at"))
    )


def blocked_searches(searches: DataFrame, pauses: DataFrame) -> DataFrame:
    """Searches under an active pause of the browser, of their source, or of their own."""
    own = searches.join(
        pauses.filter(F.col("scope") == "search").select(F.col("scope_key").alias("_k")),
        F.col("search_id").cast("string") == F.col("_k"),
        "left_semi",
    )
    source = searches.join(
        pauses.filter(F.col("scope") == "source").select(F.col("scope_key").alias("source")), "source", "left_semi"
    )
    browser = searches.join(pauses.filter(F.col("scope") == "browser").select(F.col("scope_key").alias("browser")), "browser", "left_semi")
    columns = searches.columns
    return own.select(columns).unionByName(source.select(columns)).unionByName(browser.select(columns)).distinct()
