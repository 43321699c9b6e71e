"""Sightings, prices, events, lifecycle, scans and queues over the event and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.operators import history as H
from lotwise.operators import queues as Q
from lotwise.operators import scans as S
from lotwise.operators.ordered import day_of
from lotwise.operators.rank import next_work_batch
from lotwise.session import ensure_checkpoint_dir
from lotwise.sources import tables as B
from workload import query

_TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def ts(name: str, alias: str | None = None):
    return F.date_format(name, _TS).alias(alias or name)


def sql_ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


@query(
    "first_last_seen",
    f"SELECT user_id, event_type, {sql_ts('min(ts)')} AS first_seen_at, {sql_ts('max(ts)')} AS last_seen_at FROM events GROUP BY user_id, event_type",
)
def first_last_seen(t):
    """First and last sighting per listing and search."""
    return H.first_last_seen(t.events, ["user_id", "event_type"], "ts").select(
        "user_id", "event_type", ts("first_seen_at"), ts("last_seen_at")
    )


@query(
    "latest_event",
    "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id",
)
def latest_event(t):
    """Latest observation per listing."""
    return H.latest_per_key(t.events, ["user_id"], ["ts", "event_id"], ["event_id", "event_type", "value"])


@query(
    "first_event",
    "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
)
def first_event(t):
    """First observation per listing."""
    return H.first_per_key(t.events, ["user_id"], ["ts", "event_id"], ["event_id", "event_type"])


@query(
    "last_known_value",
    "SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type = 'purchase' AND value IS NOT NULL GROUP BY user_id",
)
def last_known_value(t):
    """Last known value, skipping rows without one."""
    df = t.events.withColumn("value", F.when(F.col("event_type") == "purchase", F.col("value")))
    return H.last_known(df, ["user_id"], ["ts", "event_id"], "value")


_CENTS = "CAST(floor(value * 100000 + 0.5) AS BIGINT)"
_PRICES = f"""WITH p AS (SELECT user_id, ts, event_id, {_CENTS} AS price FROM events WHERE value IS NOT NULL),
l AS (SELECT *, lag(price) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_price FROM p),
c AS (SELECT *, price - previous_price AS d, CASE WHEN previous_price IS NOT NULL THEN greatest(10000, CAST(ceil(previous_price * 0.01) AS BIGINT)) END AS threshold FROM l
  WHERE previous_price IS NULL OR previous_price <> price)"""


def _prices(t):
    df = t.events.withColumn("price", F.expr(_CENTS))
    return H.price_changes(df, ["user_id"], "ts", "price", ["ts", "event_id"], day_of("ts"))


@query(
    "price_changes",
    _PRICES
    + """ SELECT user_id, event_id, price, previous_price, CASE WHEN d < 0 THEN 'decrease' WHEN d > 0 THEN 'increase' END AS direction,
      abs(d) AS difference_cents, threshold AS alert_threshold_cents, coalesce(d < 0 AND -d >= threshold, false) AS meaningful FROM c""",
)
def price_changes(t):
    """Change points of the price of each listing."""
    return _prices(t).select(
        "user_id", "event_id", "price", "previous_price", "direction", "difference_cents", "alert_threshold_cents", "meaningful"
    )


@query(
    "price_change_events",
    _PRICES
    + """ SELECT user_id, 'price:' || user_id || ':' || strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS event_key,
      (d < 0 AND -d >= threshold) AS alertable, previous_price, price FROM c WHERE previous_price IS NOT NULL""",
)
def price_events(t):
    """Events of price changes."""
    return H.price_change_events(_prices(t), "user_id", "ts", "price").select("user_id", "event_key", "alertable", "previous_price", "price")


@query(
    "discovery_events",
    f"""SELECT user_id, 'new:' || user_id AS event_key, {sql_ts('min(ts)')} AS occurred_at,
      CASE WHEN min(ts) < TIMESTAMP '2024-01-02' THEN 'initial_backlog' ELSE 'monitoring' END AS discovery_kind, min(ts) >= TIMESTAMP '2024-01-02' AS alertable
      FROM events GROUP BY user_id""",
)
def discovery(t):
    """First event of each listing; the first day is backlog."""
    initial = F.col("ts") < F.lit("2024-01-02").cast("timestamp")
    return H.discovery_events(t.events, "user_id", ["ts", "event_id"], "ts", initial).select(
        "user_id", "event_key", ts("occurred_at"), "discovery_kind", "alertable"
    )


_KIND = """CASE WHEN event_type = 'view' THEN 'seen' WHEN event_type = 'purchase' THEN 'sweep'
  WHEN event_type = 'signup' AND event_id % 50 = 0 THEN 'sold' ELSE 'miss' END"""

_LIFE = f"""
WITH log AS (SELECT user_id, ts, event_id, {_KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
born AS (SELECT user_id, min(n) FILTER (kind = 'seen') AS born, min(n) FILTER (kind = 'sold') AS any_sold FROM log GROUP BY user_id),
rows_ AS (SELECT l.* FROM log l JOIN born b USING (user_id) WHERE l.n >= b.born),
sold AS (SELECT user_id, min(n) AS sold_n, min(ts) AS first_sold, max(ts) AS sold_at FROM rows_ WHERE kind = 'sold' GROUP BY user_id),
live AS (SELECT r.* FROM rows_ r LEFT JOIN sold s USING (user_id) WHERE s.sold_n IS NULL OR r.n < s.sold_n),
isl AS (SELECT *, sum(CAST(kind = 'seen' AS INT)) OVER (PARTITION BY user_id ORDER BY n) AS island,
  max(CASE WHEN kind = 'seen' THEN ts END) OVER (PARTITION BY user_id ORDER BY n) AS seen_at FROM live),
mis AS (SELECT *, sum(CAST(kind = 'miss' AND ts > seen_at AS INT)) OVER (PARTITION BY user_id, island ORDER BY n) AS misses,
  max(island) OVER (PARTITION BY user_id) AS final_island FROM isl),
fin AS (SELECT user_id, max(misses) AS misses, min(ts) FILTER (kind = 'miss' AND misses >= 3) AS doubt_at,
  min(ts) FILTER (kind IN ('miss', 'sweep') AND misses >= 3 AND epoch(ts) - epoch(seen_at) >= 86400) AS gone_at, max(seen_at) AS tail_from
  FROM mis WHERE island = final_island GROUP BY user_id),
span AS (SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen FROM rows_ WHERE kind = 'seen' GROUP BY user_id)
SELECT user_id, CASE WHEN sold_at IS NOT NULL THEN 'sold' WHEN gone_at IS NOT NULL THEN 'inactive' WHEN doubt_at IS NOT NULL THEN 'possibly_unavailable' ELSE 'active' END AS availability,
  CAST(misses AS BIGINT) AS consecutive_misses, {sql_ts('first_seen')} AS first_seen_at, {sql_ts('last_seen')} AS last_seen_at,
  {sql_ts('doubt_at')} AS possibly_unavailable_at, {sql_ts('gone_at')} AS inactive_at, {sql_ts('sold_at')} AS sold_at
FROM span JOIN fin USING (user_id) LEFT JOIN sold USING (user_id)"""


def _shown(state):
    times = ["first_seen_at", "last_seen_at", "possibly_unavailable_at", "inactive_at", "sold_at"]
    return state.select("user_id", "availability", "consecutive_misses", *[ts(c) for c in times])


@query("lifecycle_state", _LIFE)
def lifecycle(t):
    """Availability of each listing after its whole log."""
    log = t.events.withColumn("kind", F.expr(_KIND))
    return _shown(H.lifecycle_state(log, "user_id", "ts", "kind", ["ts", "event_id"]))


def _run_folder(t) -> str:
    """A new folder for one run, under the folder the cluster shares."""
    ensure_checkpoint_dir(t.spark)
    base = t.spark.sparkContext.getCheckpointDir()
    import uuid

    return f"{base}/stream-{uuid.uuid4()}"


@query("lifecycle_stream", _LIFE)
def lifecycle_stream(t):
    """The same state from a stream of event files, folded batch by batch."""
    from lotwise.streaming.lifecycle import run_lifecycle

    root = _run_folder(t)
    # Files arrive in time order, as a scan log does: one period after the other, so that the times
    # of the files rise. Files of one period hold different listings, whose order does not matter.
    log = t.events.withColumn("period", F.floor(F.dayofmonth("ts") / 11))
    for period in range(3):
        log.filter(F.col("period") == period).drop("period").repartition(2, "user_id").write.mode("append").parquet(f"{root}/in")
    stream = (
        t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in").withColumn("kind", F.expr(_KIND))
    )
    return _shown(run_lifecycle(stream, f"{root}/state", f"{root}/log", "user_id", "ts", "kind", ["ts", "event_id"]))


# A day without a sighting is over by itself, if the log goes on that long or the sale comes later.
_TIMED = _LIFE.replace(
    "SELECT user_id, CASE WHEN sold_at",
    """, timed AS (SELECT fin.* REPLACE (CASE WHEN greatest(doubt_at, tail_from + INTERVAL 1 DAY) <= coalesce(first_sold, (SELECT max(ts) FROM events))
      THEN greatest(doubt_at, tail_from + INTERVAL 1 DAY) END AS gone_at) FROM fin LEFT JOIN sold USING (user_id) WHERE doubt_at IS NOT NULL
      UNION ALL SELECT fin.* FROM fin WHERE doubt_at IS NULL)
SELECT user_id, CASE WHEN sold_at""",
).replace("FROM span JOIN fin USING", "FROM span JOIN timed USING")


@query("lifecycle_timers", _TIMED)
def lifecycle_timers(t):
    """States of a stream whose doubtful listings become inactive when their timer runs out."""
    from lotwise.streaming.lifecycle import run_lifecycle

    root = _run_folder(t)
    for period in range(3):
        t.events.filter(F.floor(F.dayofmonth("ts") / 11) == period).repartition(2, "user_id").write.mode("append").parquet(f"{root}/in")
    stream = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in").withColumn("kind", F.expr(_KIND))
    return _shown(run_lifecycle(stream, f"{root}/state", f"{root}/log", "user_id", "ts", "kind", ["ts", "event_id"], timers=True))


@query(
    "expire_inactive",
    f"""WITH s AS ({_LIFE}) SELECT user_id, CASE WHEN availability IN ('active', 'possibly_unavailable') AND consecutive_misses >= 3
      AND CAST(last_seen_at AS TIMESTAMP) <= TIMESTAMP '2024-02-15' - INTERVAL 1 DAY THEN 'inactive' ELSE availability END AS availability FROM s""",
)
def expire(t):
    """Sweep of stored states."""
    log = t.events.withColumn("kind", F.expr(_KIND))
    state = H.lifecycle_state(log, "user_id", "ts", "kind", ["ts", "event_id"])
    return H.expire_inactive(state, F.lit("2024-02-15").cast("timestamp")).select("user_id", "availability")


@query(
    "mark_sold",
    f"""WITH s AS ({_LIFE}), m AS (SELECT user_id, max(ts) AS at FROM events WHERE event_type = 'purchase' AND value > 100 GROUP BY user_id)
      SELECT s.user_id, CASE WHEN m.at IS NOT NULL THEN 'sold' ELSE availability END AS availability, coalesce({sql_ts('m.at')}, sold_at) AS sold_at FROM s LEFT JOIN m ON s.user_id = m.user_id""",
)
def sold(t):
    """Sold marks set by users."""
    log = t.events.withColumn("kind", F.expr(_KIND))
    state = H.lifecycle_state(log, "user_id", "ts", "kind", ["ts", "event_id"])
    marks = t.events.filter("event_type = 'purchase' AND value > 100").select("user_id", F.col("ts").alias("sold_at"), F.lit("user").alias("sold_reason"))
    return H.mark_sold(state, marks, "user_id").select("user_id", "availability", ts("sold_at"))


_CARDS = "cards AS (SELECT user_id, event_type IN ('view', 'click', 'error') AS known, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"
_STREAK = _CARDS + ", streaks AS (SELECT *, n - coalesce(max(CASE WHEN NOT known THEN n END) OVER (PARTITION BY user_id ORDER BY n), 0) AS streak FROM cards)"


def _cards(t):
    # Positions of cards inside a scan, counted without sorting a whole scan in one task.
    from lotwise.operators.ordered import day_of, running

    placed = running(t.events, ["user_id"], day_of("ts"), ["ts", "event_id"], {"position": ("sum", F.lit(1))})
    return placed.withColumn("known", F.col("event_type").isin("view", "click", "error"))


@query("known_streak", "WITH " + _STREAK + " SELECT user_id, max(streak) AS longest, max(n) AS cards FROM streaks GROUP BY user_id")
def known_streak(t):
    """Longest run of known cards per scan."""
    walked = S.known_streak(_cards(t), ["user_id"], "position", F.col("known"))
    return walked.groupBy("user_id").agg(F.max("streak").alias("longest"), F.max("cards_seen").alias("cards"))


@query(
    "scan_stop_point",
    "WITH "
    + _STREAK
    + """, rules AS (SELECT *, CASE WHEN user_id % 3 = 0 AND n >= 30 THEN 'initial_limit' WHEN user_id % 3 <> 0 AND streak >= 6 THEN 'known_streak' WHEN n >= 50 THEN 'card_limit' END AS reason FROM streaks),
    stops AS (SELECT user_id, min(n) FILTER (reason IS NOT NULL) AS stop_at, arg_min(reason, n) FILTER (reason IS NOT NULL) AS why FROM rules GROUP BY user_id)
    SELECT user_id, count(*) AS cards_seen, count(*) FILTER (NOT known) AS new_cards, coalesce(any_value(why), 'results_end') AS stop_reason
    FROM rules JOIN stops USING (user_id) WHERE stop_at IS NULL OR n <= stop_at GROUP BY user_id""",
)
def stop_point(t):
    """Where each scan stops and why."""
    return S.scan_stop_point(
        _cards(t), ["user_id"], "position", F.col("known"), F.col("user_id") % 3 == 0, initial_limit=30, streak_limit=6, card_limit=50
    )


_SHOWN = """shown AS (SELECT user_id, event_id % 60 AS card, event_type IN ('view', 'click', 'error') AS known, event_type <> 'purchase' AS existing, n, (n - 1) // 4 AS shot FROM
      (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)),
    once AS (SELECT s.* FROM shown s JOIN (SELECT user_id, card, min(n) AS n FROM shown GROUP BY ALL) USING (user_id, card, n)),
    shots AS (SELECT user_id, shot, coalesce(any_value(added), 0) AS added FROM (SELECT DISTINCT user_id, shot FROM shown) LEFT JOIN (SELECT user_id, shot, count(*) AS added FROM once GROUP BY ALL) USING (user_id, shot) GROUP BY ALL),
    stall AS (SELECT user_id, min(shot) AS stall FROM (SELECT *, row_number() OVER w - coalesce(max(CASE WHEN added > 0 THEN shot + 1 END) OVER w, 0) AS empty FROM shots WINDOW w AS (PARTITION BY user_id ORDER BY shot)) WHERE empty >= 3 GROUP BY user_id),
    seen AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n) AS place FROM once LEFT JOIN stall USING (user_id) WHERE stall IS NULL OR shot <= stall),
    streaks AS (SELECT *, place - coalesce(max(CASE WHEN NOT known THEN place END) OVER (PARTITION BY user_id ORDER BY place), 0) AS streak FROM seen),
    rules AS (SELECT *, CASE WHEN user_id % 3 = 0 AND place >= 30 THEN 'initial_limit' WHEN user_id % 3 = 1 AND streak >= 6 THEN 'known_streak' WHEN place >= 70 THEN 'card_limit' END AS reason FROM streaks),
    stops AS (SELECT user_id, min(place) FILTER (reason IS NOT NULL) AS stop_at, arg_min(reason, place) FILTER (reason IS NOT NULL) AS why FROM rules GROUP BY user_id)"""


@query(
    "scan_stop_rules",
    "WITH " + _SHOWN + """ SELECT user_id, count(*) AS cards_seen, count(*) FILTER (NOT existing) AS new_cards,
      coalesce(any_value(why), CASE WHEN max(stall) IS NOT NULL THEN 'no_progress' ELSE 'results_end' END) AS stop_reason
    FROM rules JOIN stops USING (user_id) WHERE stop_at IS NULL OR place <= stop_at GROUP BY user_id""",
)
def stop_rules(t):
    """Stops with cards shown again, cards known to other searches, and snapshots without progress."""
    cards = _cards(t).withColumns(
        {
            "card": F.col("event_id") % 60,
            "shot": F.floor((F.col("position") - 1) / 4),
            "standard": F.when(F.col("user_id") % 3 == 2, F.lit("deep")).otherwise(F.lit("standard")),
        }
    )
    return S.scan_stop_point(
        cards, ["user_id"], "position", F.col("known"), F.col("user_id") % 3 == 0, F.col("standard"), initial_limit=30, streak_limit=6, card_limit=70,
        existing=F.col("event_type") != "purchase", card="card", snapshot="shot",
    )


@query(
    "running_limit",
    "WITH " + _CARDS + " SELECT user_id, count(*) AS kept, count(*) FILTER (known) AS known FROM cards WHERE n <= 25 GROUP BY user_id",
)
def running_limit(t):
    """Cards inside a running limit."""
    walked = S.known_streak(_cards(t), ["user_id"], "position", F.col("known"))
    return walked.filter("cards_seen <= 25").groupBy("user_id").agg(F.count("*").alias("kept"), F.count_if("known").alias("known"))


_PAGES = """p AS (SELECT l_suppkey AS scan, l_linenumber AS page, l_partkey AS listing, l_orderkey AS position FROM lineitem),
firsts AS (SELECT scan, listing, min(page) AS page FROM p GROUP BY scan, listing),
added AS (SELECT scan, page, count(*) AS added FROM firsts GROUP BY scan, page),
pages AS (SELECT scan, page, count(*) AS cards, coalesce(any_value(added), 0) AS added FROM p LEFT JOIN added USING (scan, page) GROUP BY scan, page)"""


@query(
    "collect_pages",
    "WITH "
    + _PAGES
    + """, walk AS (SELECT *, sum(added) OVER (PARTITION BY scan ORDER BY page) AS collected,
        page_n - coalesce(max(CASE WHEN added > 0 THEN page_n END) OVER (PARTITION BY scan ORDER BY page), 0) AS empty
      FROM (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY page) AS page_n FROM pages WHERE page <= 6)),
    stops AS (SELECT scan, min(page) FILTER (collected >= 400) AS full_page, min(page) FILTER (empty >= 2) AS stall, max(page) AS last_page FROM walk GROUP BY scan)
    SELECT scan, count(*) AS pages_scanned, CAST(sum(cards) AS BIGINT) AS recognized_cards, CAST(least(max(collected), 400) AS BIGINT) AS listings,
      CASE WHEN any_value(full_page) IS NOT NULL AND any_value(full_page) <= coalesce(any_value(stall), 99) THEN 'listing_limit' WHEN any_value(stall) IS NOT NULL THEN 'no_progress'
        WHEN any_value(last_page) >= 6 THEN 'page_limit' ELSE 'results_end' END AS stop_reason
    FROM walk JOIN stops USING (scan) WHERE page <= coalesce(least(full_page, stall), 99) GROUP BY scan""",
)
def collect_pages(t):
    """Paged collection: first sightings count, stop at the limit or without progress."""
    cards = t.lineitem.select(
        F.col("l_suppkey").alias("scan"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("listing"), F.col("l_orderkey").alias("position")
    )
    out = S.collect_pages(cards, ["scan"], "page", "position", "listing", limit=400, page_limit=6)
    return out.withColumn("listings", F.col("listings").cast("bigint"))


_HOURS = """h AS (SELECT user_id, CAST(epoch(ts) AS BIGINT) // 86400 AS page, count(*) FILTER (event_type = 'signup') AS added FROM events GROUP BY ALL)"""


@query(
    "no_progress",
    "WITH "
    + _HOURS
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY page) AS n FROM h)
    SELECT user_id, page, added, n - coalesce(max(CASE WHEN added > 0 THEN n END) OVER (PARTITION BY user_id ORDER BY page), 0) AS empty_streak FROM n""",
)
def no_progress(t):
    """Days in a row without anything new."""
    days = t.events.groupBy("user_id", F.floor(F.unix_seconds("ts") / 86400).alias("page")).agg(
        F.count_if(F.col("event_type") == "signup").alias("added")
    )
    return S.no_progress_streak(days, ["user_id"], "page", "added").select("user_id", "page", "added", "empty_streak")


@query(
    "rejected_ratio_gate",
    """SELECT l_suppkey AS scan, count(*) AS cards, count(*) FILTER (l_discount >= 0.09) AS rejected,
      count(*) FILTER (l_discount >= 0.09) > 0 AND (count(*) < 10 OR count(*) FILTER (l_discount >= 0.09) / count(*) > 0.1) AS unsafe FROM lineitem GROUP BY l_suppkey""",
)
def ratio_gate(t):
    """Scans with too many rejected cards."""
    return S.rejected_ratio_gate(t.lineitem.withColumn("scan", F.col("l_suppkey")), ["scan"], F.col("l_discount") >= 0.09)


@query(
    "scan_report",
    """SELECT l_suppkey AS search_id, l_returnflag AS scan, count(*) AS collected, count(*) FILTER (l_quantity <= 25) AS eligible, count(*) FILTER (l_linestatus = 'O') AS created
      FROM lineitem GROUP BY ALL""",
)
def scan_report(t):
    """Counts of each scan."""
    df = t.lineitem.select(F.col("l_suppkey").alias("search_id"), F.col("l_returnflag").alias("scan"), "l_quantity", "l_linestatus")
    return S.scan_report(df, ["search_id", "scan"], eligible=F.col("l_quantity") <= 25, created=F.col("l_linestatus") == "O")


@query(
    "probe_report",
    """SELECT p_brand, count(*) AS listings, count(*) FILTER (p_partkey % 4 = 0 OR p_partkey % 7 = 0) AS with_gaps, count(*) FILTER (p_partkey % 4 = 0) AS missing_variant,
      count(*) FILTER (p_partkey % 7 = 0) AS missing_fuel, count(*) FILTER (p_retailprice <= 950) AS eligible, count(*) FILTER (p_retailprice > 950) AS ineligible FROM part GROUP BY p_brand""",
)
def probe(t):
    """Missing facts and budget fit of a sample."""
    df = t.part.selectExpr(
        "p_brand",
        "CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS variant",
        "CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS fuel",
        "CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents",
    )
    return S.probe_report(df, ["p_brand"], ["variant", "fuel"], "price_cents", 950)


@query(
    "scan_success_state",
    f"""SELECT user_id, {sql_ts('max(ts)')} AS last_attempt_at, {sql_ts("max(ts) FILTER (event_type <> 'error')")} AS last_success_at,
      arg_max_null(CASE WHEN event_type = 'error' THEN event_type END, ts) AS last_error FROM events GROUP BY user_id""",
)
def success_state(t):
    """Last attempt, last success and last error per search."""
    runs = t.events.withColumn("error", F.when(F.col("event_type") == "error", F.col("event_type")))
    return S.scan_success_state(runs, "user_id", "ts", "error").select("user_id", ts("last_attempt_at"), ts("last_success_at"), "last_error")


_FAIL = """f AS (SELECT user_id, max(ts) AS last_scan_at, max(ts) FILTER (event_type <> 'error') AS ok FROM events GROUP BY user_id),
n AS (SELECT e.user_id, any_value(last_scan_at) AS last_scan_at, count(*) FILTER (e.event_type = 'error' AND (ok IS NULL OR ts > ok)) AS failures FROM events e JOIN f USING (user_id) GROUP BY e.user_id),
s AS (SELECT *, make_timestamp((epoch_us(last_scan_at) // 1000) * 1000 + CAST(floor(least(30.0, 15.0 + (user_id % 10) / 10.0 * 15 + (user_id % 5) * 0.5) * CASE WHEN failures = 0 THEN 1 ELSE least(4.0, power(2.0, failures)) END * 60000) AS BIGINT) * 1000) AS next_scan_at FROM n)"""


def _schedule(t):
    failed = S.trailing_failures(t.events, "user_id", "ts", F.col("event_type") == "error")
    return S.schedule_next(failed, "last_scan_at", F.col("user_id") % 5 + 1, F.col("failures"), (F.col("user_id") % 10) / 10.0)


@query("schedule_next", "WITH " + _FAIL + f" SELECT user_id, failures, {sql_ts('next_scan_at')} AS next_scan_at FROM s")
def schedule(t):
    """Next scan of each search after its failures."""
    return _schedule(t).select("user_id", "failures", ts("next_scan_at"))


@query(
    "due_list",
    "WITH " + _FAIL + f" SELECT user_id AS search_id, {sql_ts('next_scan_at')} AS next_scan_at FROM s WHERE next_scan_at <= TIMESTAMP '2024-01-30 12:00:00'",
)
def due(t):
    """Searches that are due."""
    df = _schedule(t).withColumnRenamed("user_id", "search_id")
    return S.due_list(df, F.lit("2024-01-30 12:00:00").cast("timestamp")).select("search_id", ts("next_scan_at"))


@query("min_due", "WITH " + _FAIL + f" SELECT {sql_ts('min(next_scan_at)')} AS next_scan_at FROM s")
def min_due(t):
    """Earliest due time."""
    return S.min_due(_schedule(t)).select(ts("next_scan_at"))


_RUNS = """runs AS (SELECT o_orderkey AS run_id, o_custkey AS search_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'succeeded' END AS state,
  CASE WHEN o_orderkey % 7 = 0 THEN 'deep' ELSE 'standard' END AS mode, o_orderdate AS requested_at FROM orders)"""


def _runs(t):
    return t.orders.selectExpr(
        "o_orderkey AS run_id",
        "o_custkey AS search_id",
        "CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'succeeded' END AS state",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'deep' ELSE 'standard' END AS mode",
        "o_orderdate AS requested_at",
    )


@query(
    "queue_by_priority",
    "WITH " + _RUNS + """ SELECT run_id, search_id, CAST(c_nationkey AS INT) AS priority FROM runs LEFT JOIN customer ON search_id = c_custkey AND c_acctbal > 0
      WHERE state = 'queued'""",
)
def priority_queue(t):
    """Queued runs with the priority of their search."""
    searches = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("search_id"), F.col("c_nationkey").alias("priority"))
    return S.queue_by_priority(_runs(t), searches).select("run_id", "search_id", "priority")


@query(
    "scan_run_recovery",
    "WITH "
    + _RUNS
    + """, per AS (SELECT search_id, bool_or(state = 'queued') AS queued, bool_or(state = 'running' AND mode = 'deep') AS deep FROM runs GROUP BY search_id)
    SELECT run_id, CASE WHEN state = 'running' AND queued THEN 'failed' WHEN state = 'running' THEN 'queued' ELSE state END AS state,
      CASE WHEN state = 'queued' AND deep THEN 'deep' ELSE mode END AS mode, CASE WHEN state = 'running' AND queued THEN 'INTERRUPTED' END AS error_code FROM runs JOIN per USING (search_id)""",
)
def run_recovery(t):
    """Runs after a restart."""
    return S.requeue_interrupted(_runs(t)).select("run_id", "state", "mode", "error_code")


@query(
    "scan_run_states",
    """SELECT l_orderkey AS run_id, arg_max(l_linestatus, (l_shipdate, l_linenumber * 1000000 + l_partkey * 10 + l_suppkey % 10)) AS state,
      CASE WHEN bool_or(l_returnflag = 'R') THEN 'deep' ELSE 'standard' END AS mode FROM lineitem GROUP BY l_orderkey""",
)
def run_states(t):
    """Latest state of each run from its log."""
    log = t.lineitem.select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_shipdate").alias("at"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 10 + F.col("l_suppkey") % 10).alias("seq"),
        F.col("l_suppkey").alias("search_id"),
        F.col("l_linestatus").alias("state"),
        F.when(F.col("l_returnflag") == "R", F.lit("deep")).otherwise(F.lit("standard")).alias("mode"),
    )
    return S.scan_run_states(log).select("run_id", "state", "mode")


@query(
    "pause_state",
    f"""WITH l AS (SELECT 'search' AS scope, user_id AS scope_key, ts, event_id, CASE WHEN event_type = 'error' THEN 'pause' ELSE 'resolve' END AS kind FROM events WHERE event_type IN ('error', 'purchase'))
    SELECT scope, CAST(scope_key AS VARCHAR) AS scope_key, {sql_ts('max(ts)')} AS paused_at FROM l GROUP BY scope, scope_key HAVING arg_max(kind, (ts, event_id)) = 'pause'""",
)
def pauses(t):
    """Active pause of each search."""
    log = t.events.filter(F.col("event_type").isin("error", "purchase")).select(
        F.lit("search").alias("scope"),
        F.col("user_id").cast("string").alias("scope_key"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", F.lit("pause")).otherwise(F.lit("resolve")).alias("kind"),
        F.lit("partial_load").alias("failure_kind"),
        F.lit(None).cast("string").alias("detail"),
    )
    return S.pause_state(log).select("scope", "scope_key", ts("paused_at"))


@query(
    "circuit_breaker",
    f"""WITH l AS (SELECT ts, event_id, CASE WHEN value > 150 THEN 'pause' ELSE 'resume' END AS kind FROM events WHERE value > 150 OR event_type = 'signup'),
    p AS (SELECT *, lag(kind) OVER (ORDER BY ts, event_id) AS before FROM l),
    o AS (SELECT ts AS paused_at, row_number() OVER (ORDER BY ts, event_id) AS generation FROM p WHERE kind = 'pause' AND coalesce(before, 'resume') <> 'pause'),
    c AS (SELECT ts AS resumed_at, row_number() OVER (ORDER BY ts, event_id) AS generation FROM p WHERE kind = 'resume' AND before = 'pause')
    SELECT generation, {sql_ts('paused_at')} AS paused_at, {sql_ts('resumed_at')} AS resumed_at FROM o LEFT JOIN c USING (generation)""",
)
def breaker(t):
    """Pause episodes of all downstream work."""
    log = t.events.filter("value > 150 OR event_type = 'signup'").select(
        F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("value") > 150, F.lit("pause")).otherwise(F.lit("resume")).alias("kind")
    )
    return Q.circuit_breaker(log).select("generation", ts("paused_at"), ts("resumed_at"))


_ATTEMPT = "CASE event_type WHEN 'view' THEN 'succeeded' WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'processing' END"


@query(
    "capture_cooldown",
    f"""WITH a AS (SELECT user_id AS listing_id, max(ts) AS tried_at, arg_max({_ATTEMPT}, ts) AS state FROM events GROUP BY user_id),
    d AS (SELECT user_id AS listing_id, max(ts) AS captured_at FROM events WHERE event_type = 'view' GROUP BY user_id),
    n AS (SELECT *, CASE state WHEN 'succeeded' THEN tried_at + INTERVAL 7 DAY WHEN 'failed' THEN tried_at + INTERVAL 1 DAY ELSE tried_at END AS next_at FROM a FULL JOIN d USING (listing_id))
    SELECT listing_id, coalesce(state, 'not_captured') AS state, {sql_ts('next_at')} AS next_attempt_at,
      coalesce(captured_at <= TIMESTAMP '2024-02-02' - INTERVAL 7 DAY, true) AS stale,
      coalesce(captured_at <= TIMESTAMP '2024-02-02' - INTERVAL 7 DAY, true) AND (state IS NULL OR (state <> 'processing' AND next_at <= TIMESTAMP '2024-02-02')) AS can_capture FROM n""",
)
def cooldown(t):
    """When a detail page may be captured again."""
    attempts = t.events.select(F.col("user_id").alias("listing_id"), F.col("ts").alias("at"), F.expr(_ATTEMPT).alias("state"), F.lit(None).cast("string").alias("error_code"))
    details = t.events.filter("event_type = 'view'").groupBy(F.col("user_id").alias("listing_id")).agg(F.max("ts").alias("captured_at"))
    out = Q.capture_cooldown(attempts, details, F.lit("2024-02-02").cast("timestamp"))
    return out.select("listing_id", "state", ts("next_attempt_at"), "stale", "can_capture")


@query(
    "review_workflow",
    """WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, arg_max(event_id, (ts, event_id)) AS reason FROM events WHERE event_type <> 'signup' GROUP BY user_id),
    a AS (SELECT user_id, arg_max(event_id % 2 = 0, (ts, event_id)) AS archived FROM events WHERE event_type = 'signup' GROUP BY user_id)
    SELECT user_id AS listing_id, CASE coalesce(state, 'new') WHEN 'error' THEN 'rejected' ELSE coalesce(state, 'new') END AS state,
      CASE WHEN state = 'error' THEN CAST(reason AS VARCHAR) END AS rejection_reason, coalesce(archived, false) AS archived FROM s FULL JOIN a USING (user_id)""",
)
def reviews(t):
    """Latest review of each listing."""
    log = t.events.select(
        F.col("user_id").alias("listing_id"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", F.lit("archive")).otherwise(F.lit("state")).alias("kind"),
        F.when(F.col("event_type") == "error", F.lit("rejected")).otherwise(F.col("event_type")).alias("state"),
        F.col("event_id").cast("string").alias("reason"),
        (F.col("event_id") % 2 == 0).alias("archived"),
    )
    return Q.review_state(log).select("listing_id", "state", "rejection_reason", "archived")


_QUEUE = """queue AS (SELECT o_orderkey AS listing_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'processing' ELSE 'completed' END AS state, o_orderdate AS requested_at, o_orderdate AS available_at FROM orders),
excluded AS (SELECT DISTINCT l_orderkey AS listing_id FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08)"""


def _queue(t):
    queue = t.orders.selectExpr(
        "o_orderkey AS listing_id",
        "CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'processing' ELSE 'completed' END AS state",
        "o_orderdate AS requested_at",
        "o_orderdate AS available_at",
        "CAST(NULL AS STRING) AS last_error_code",
        "'all' AS switch",
    )
    excluded = t.lineitem.filter("l_returnflag = 'R' AND l_discount > 0.08").select(F.col("l_orderkey").alias("listing_id")).distinct()
    return queue, excluded


@query(
    "queue_recovery",
    "WITH "
    + _QUEUE
    + """ SELECT listing_id, CASE WHEN e.listing_id IS NOT NULL AND state IN ('processing', 'queued') THEN 'cancelled' WHEN state = 'processing' THEN 'queued' ELSE state END AS new_state,
      CASE WHEN e.listing_id IS NOT NULL AND state IN ('processing', 'queued') THEN 'excluded_by_classifier' WHEN state = 'processing' THEN 'interrupted' END AS last_error_code
      FROM queue q LEFT JOIN excluded e USING (listing_id)""".replace("e.listing_id IS NOT NULL", "hit IS NOT NULL").replace(
        "LEFT JOIN excluded e USING", "LEFT JOIN (SELECT listing_id, 1 AS hit FROM excluded) e USING"
    ),
)
def recovery(t):
    """Work after a restart."""
    queue, excluded = _queue(t)
    out = Q.queue_recovery(queue, excluded, F.lit("2024-01-01").cast("timestamp"))
    return out.select("listing_id", F.col("state").alias("new_state"), "last_error_code")


@query(
    "next_work_batch",
    "WITH "
    + _QUEUE
    + f""" SELECT listing_id, {sql_ts('requested_at')} AS requested_at FROM queue WHERE state = 'queued' AND available_at <= TIMESTAMP '2000-06-01'
      AND listing_id NOT IN (SELECT listing_id FROM excluded) ORDER BY requested_at, listing_id LIMIT 20""",
)
def work_batch(t):
    """Oldest due work, unless all work is paused."""
    queue, excluded = _queue(t)
    control = t.events.agg(F.max("ts").alias("at")).select(F.lit("all").alias("switch"), F.when(F.col("at").isNotNull(), F.lit("active")).alias("state"))
    return next_work_batch(queue, excluded, control, F.lit("2000-06-01").cast("timestamp"), 20).select("listing_id", ts("requested_at"))


@query(
    "retry_times",
    f"""SELECT event_id, CASE event_type WHEN 'error' THEN 'rate_limited' WHEN 'click' THEN 'timeout' WHEN 'view' THEN 'upstream_failure' ELSE 'invalid_response' END AS failure,
      CASE event_type WHEN 'error' THEN {sql_ts('ts + INTERVAL 60 SECOND')} WHEN 'click' THEN {sql_ts('ts + INTERVAL 15 SECOND')} WHEN 'view' THEN {sql_ts('ts + INTERVAL 30 SECOND')} END AS retry_at FROM events""",
)
def retries(t):
    """When failed work is tried again."""
    failure = F.expr("CASE event_type WHEN 'error' THEN 'rate_limited' WHEN 'click' THEN 'timeout' WHEN 'view' THEN 'upstream_failure' ELSE 'invalid_response' END")
    df = t.events.withColumn("failure", failure).withColumn("retry", Q.retry_at(F.col("failure"), F.col("ts")))
    return df.select("event_id", "failure", ts("retry", "retry_at"))


_HALF = "TIMESTAMP '2024-01-15'"


def _halves(t):
    half = F.lit("2024-01-15").cast("timestamp")
    return t.events.filter(F.col("ts") < half), t.events.filter(F.col("ts") >= half)


@query(
    "append_once",
    f"""WITH o AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < {_HALF} AND event_id % 3 = 0), n AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts >= {_HALF})
    SELECT user_id, event_type FROM n EXCEPT SELECT user_id, event_type FROM o""",
)
def append_once(t):
    """New keys only."""
    old, new = _halves(t)
    return B.append_once(old.filter("event_id % 3 = 0"), new, ["user_id", "event_type"]).select("user_id", "event_type")


@query(
    "upsert_minmax",
    f"""SELECT user_id, {sql_ts('min(ts)')} AS first_seen_at, {sql_ts('max(ts)')} AS last_seen_at, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id""",
)
def upsert_minmax(t):
    """Sightings merged with stored ones."""
    old, new = _halves(t)
    shape = lambda df: df.groupBy("user_id").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))
    return B.upsert_minmax(shape(old), shape(new), ["user_id"], ["event_id"]).select("user_id", ts("first_seen_at"), ts("last_seen_at"), "event_id")


@query("upsert_latest", "SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def upsert_latest(t):
    """Last write per key wins."""
    old, new = _halves(t)
    shape = lambda df: H.latest_per_key(df, ["user_id"], ["ts", "event_id"], ["ts", "value", "event_type"])
    return B.upsert_latest(shape(old), shape(new), ["user_id"], "ts").select("user_id", "value", "event_type")


@query(
    "replay_dedupe",
    "SELECT event_id, user_id, event_type, value FROM events",
)
def replay_dedupe(t):
    """A doubled stream keeps each row once."""
    from lotwise.streaming.lifecycle import dedupe_stream

    root = _run_folder(t)
    t.events.write.parquet(f"{root}/in")
    t.events.write.mode("append").parquet(f"{root}/in")
    stream = dedupe_stream(t.spark.readStream.schema(t.events.schema).parquet(f"{root}/in"), ["event_id"], "ts", "40 days")
    run = (
        stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return t.spark.read.schema(t.events.schema).parquet(f"{root}/out").select("event_id", "user_id", "event_type", "value")


_QUEUE_LOG = """steps AS (SELECT CAST(user_id * 100 + day(ts) AS BIGINT) AS listing_id, ts AS tm, event_id AS seq,
    CASE WHEN event_id % 40 = 0 THEN 'exclude' WHEN event_id % 40 = 1 THEN 'include' WHEN event_type = 'signup' OR event_id % 7 = 0 THEN 'enqueue'
      WHEN event_type = 'view' OR event_type = 'click' THEN 'claim' WHEN event_type = 'purchase' THEN 'success' ELSE 'failure' END AS kind,
    CAST(floor(value / 40) AS BIGINT) AS version,
    CASE event_id % 4 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'timeout' WHEN 2 THEN 'upstream_failure' ELSE 'invalid_response' END AS failure FROM events)"""


@query(
    "enrichment_queue_state",
    "WITH RECURSIVE " + _QUEUE_LOG + f""", e AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY tm, seq) AS n FROM steps),
    q AS (
      SELECT DISTINCT listing_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS BIGINT) AS version, CAST(NULL AS TIMESTAMP) AS requested_at, CAST(NULL AS TIMESTAMP) AS available_at,
        CAST(NULL AS TIMESTAMP) AS started_at, CAST(NULL AS TIMESTAMP) AS completed_at, CAST(0 AS BIGINT) AS attempts, CAST(NULL AS VARCHAR) AS code, CAST(NULL AS BIGINT) AS claimed, false AS excluded FROM steps
      UNION ALL
      SELECT listing_id, n,
        CASE act WHEN 'ask' THEN CASE WHEN state IS NULL THEN 'queued' WHEN same AND state <> 'cancelled' THEN state WHEN NOT same AND state = 'processing' THEN state ELSE 'queued' END
          WHEN 'claim' THEN 'processing' WHEN 'done' THEN CASE WHEN cur THEN 'completed' ELSE 'queued' END
          WHEN 'fail' THEN CASE WHEN cur AND failure = 'invalid_response' THEN 'failed' ELSE 'queued' END WHEN 'cancel' THEN 'cancelled' ELSE state END,
        CASE act WHEN 'ask' THEN e_version ELSE version END,
        CASE WHEN act = 'ask' AND NOT (same AND state <> 'cancelled') THEN tm ELSE requested_at END,
        CASE WHEN act = 'ask' AND NOT (same AND state <> 'cancelled') THEN tm WHEN act = 'done' THEN tm
          WHEN act = 'fail' THEN CASE WHEN cur THEN tm + to_seconds(CASE failure WHEN 'rate_limited' THEN 60 WHEN 'timeout' THEN 15 WHEN 'upstream_failure' THEN 30 ELSE 0 END) ELSE tm END ELSE available_at END,
        CASE WHEN act = 'claim' THEN tm WHEN act IN ('done', 'fail', 'cancel') THEN NULL ELSE started_at END,
        CASE WHEN act = 'ask' AND NOT (same AND state <> 'cancelled') THEN NULL WHEN act = 'done' AND cur THEN tm WHEN act IN ('done', 'fail', 'cancel') THEN NULL ELSE completed_at END,
        CASE WHEN act = 'claim' THEN attempts + 1 ELSE attempts END,
        CASE WHEN act = 'ask' AND NOT (same AND state <> 'cancelled') THEN NULL WHEN act = 'done' THEN NULL WHEN act = 'fail' THEN failure WHEN act = 'cancel' THEN 'excluded_by_classifier' ELSE code END,
        CASE WHEN act = 'claim' THEN version ELSE claimed END,
        CASE kind WHEN 'exclude' THEN true WHEN 'include' THEN false ELSE excluded END
      FROM (SELECT q.*, e.n AS en, e.tm, e.kind, e.failure, e.version AS e_version, state IS NOT NULL AND q.version IS NOT DISTINCT FROM e.version AS same, q.version IS NOT DISTINCT FROM claimed AS cur,
          CASE WHEN kind = 'enqueue' AND NOT excluded THEN 'ask' WHEN kind = 'claim' AND state = 'queued' AND available_at <= e.tm THEN 'claim' WHEN kind = 'success' AND state = 'processing' THEN 'done'
            WHEN kind = 'failure' AND state = 'processing' THEN 'fail' WHEN kind = 'exclude' AND state IN ('queued', 'processing', 'failed') THEN 'cancel' END AS act
        FROM q JOIN e ON e.listing_id = q.listing_id AND e.n = q.n + 1) AS s(listing_id, old_n, state, version, requested_at, available_at, started_at, completed_at, attempts, code, claimed, excluded, n, tm, kind, failure, e_version, same, cur, act)
    )
    SELECT listing_id, arg_max(state, n) AS state, arg_max(coalesce(version, -1), n) AS version, {sql_ts("arg_max(requested_at, n)")} AS requested_at, {sql_ts("arg_max(available_at, n)")} AS available_at,
      arg_max(attempts, n) AS attempts, arg_max(coalesce(code, ''), n) AS last_error_code FROM q GROUP BY listing_id HAVING arg_max(coalesce(state, ''), n) <> ''""",
)
def enrichment_queue_state(t):
    """Work state of each listing after its whole log of requests, claims, results and exclusions."""
    e, n = F.col("event_type"), F.col("event_id")
    kind = (
        F.when(n % 40 == 0, F.lit("exclude")).when(n % 40 == 1, F.lit("include")).when((e == "signup") | (n % 7 == 0), F.lit("enqueue"))
        .when(e.isin("view", "click"), F.lit("claim")).when(e == "purchase", F.lit("success")).otherwise(F.lit("failure"))
    )
    failure = F.when(n % 4 == 0, F.lit("rate_limited")).when(n % 4 == 1, F.lit("timeout")).when(n % 4 == 2, F.lit("upstream_failure")).otherwise(F.lit("invalid_response"))
    log = t.events.select(
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("listing_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"),
        F.floor(F.col("value") / 40).cast("bigint").alias("version"), failure.alias("failure"),
    )
    return Q.enrichment_queue(log).select(
        "listing_id", "state", F.coalesce("version", F.lit(-1)).alias("version"), ts("requested_at"), ts("available_at"), "attempts", F.coalesce("last_error_code", F.lit("")).alias("last_error_code")
    )


_PAUSES = """pauses AS (SELECT CASE user_id % 3 WHEN 0 THEN 'browser' WHEN 1 THEN 'source' ELSE 'search' END AS scope,
    CASE user_id % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'src' || user_id % 5 ELSE CAST(user_id AS VARCHAR) END AS scope_key,
    arg_max(event_type <> 'purchase', (ts, event_id)) AS paused FROM events WHERE user_id % 3 <> 0 GROUP BY ALL)"""


@query(
    "blocked_searches",
    "WITH " + _PAUSES + """ SELECT c_custkey AS search_id, 'src' || c_nationkey % 5 AS source, 'b' AS browser FROM customer
      WHERE EXISTS (SELECT 1 FROM pauses WHERE paused AND (scope = 'source' AND scope_key = 'src' || c_nationkey % 5 OR scope = 'search' AND scope_key = CAST(c_custkey AS VARCHAR)))""",
)
def blocked(t):
    """Searches under an active pause of their source or of their own."""
    log = t.events.filter("user_id % 3 <> 0").select(
        F.when(F.col("user_id") % 3 == 1, F.lit("source")).otherwise(F.lit("search")).alias("scope"),
        F.when(F.col("user_id") % 3 == 1, F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string"))).otherwise(F.col("user_id").cast("string")).alias("scope_key"),
        F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", F.lit("resolve")).otherwise(F.lit("pause")).alias("kind"),
        F.lit("rate_limited").alias("failure_kind"), F.lit("").alias("detail"),
    )
    searches = t.customer.select(F.col("c_custkey").alias("search_id"), F.concat(F.lit("src"), (F.col("c_nationkey") % 5).cast("string")).alias("source"), F.lit("b").alias("browser"))
    return S.blocked_searches(searches, S.pause_state(log))


@query(
    "late_observations",
    f"""WITH a AS (SELECT user_id, event_id, ts, CAST(floor(value) AS BIGINT) AS price, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events),
    k AS (SELECT *, lag(price) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM a WHERE top IS NULL OR ts >= top)
    SELECT user_id, event_id, {sql_ts("ts")} AS at, price, previous AS previous_price FROM k WHERE previous IS NULL OR previous <> price""",
)
def late_observations(t):
    """Price changes in order of arrival: a row older than one before it changes nothing."""
    rows = t.events.select("user_id", "event_id", "ts", F.floor("value").cast("bigint").alias("price"))
    changes = H.price_changes(rows, ["user_id"], "ts", "price", ["event_id"], F.floor(F.col("event_id") / 4096))
    return changes.select("user_id", "event_id", ts("ts").alias("at"), "price", "previous_price")
