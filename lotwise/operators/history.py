"""Sightings, price history, events and listing lifecycle from observation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators.ordered import day_of, running

MISSES_UNTIL_DOUBTFUL = 3
INACTIVE_AFTER_SECONDS = 24 * 60 * 60
MIN_ALERT_CENTS = 10_000


def first_last_seen(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Last row per key by ``order``; an aggregate, so hot keys are reduced before the shuffle."""
    row = F.struct(*order, *[F.col(c).alias(f"v_{c}") for c in columns])
    return df.groupBy(*keys).agg(F.max(row).alias("_r")).select(*keys, *[F.col(f"_r.v_{c}").alias(c) for c in columns])


def first_per_key(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    row = F.struct(*order, *[F.col(c).alias(f"v_{c}") for c in columns])
    return df.groupBy(*keys).agg(F.min(row).alias("_r")).select(*keys, *[F.col(f"_r.v_{c}").alias(c) for c in columns])


def last_known(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """Last non-null value per key."""
    return latest_per_key(df.filter(F.col(column).isNotNull()), keys, order, [column])


def price_changes(
    df: DataFrame,
    key: list[str],
    at: str,
    price: str,
    order: list[str] | None = None,
    chunk: Column | None = None,
    engagement: str | None = None,
) -> DataFrame:
    """One row per change point: previous price, direction, difference, threshold, meaningful.

    ``order`` is the order of arrival (event time by default). A row that arrives with an older
    time than one before it changes nothing. The first known price opens the history. ``chunk`` cuts
    that order into runs (see ``running``) and is required with it.
    """
    if order is not None and order != [at] and chunk is None:
        raise ValueError("an order of arrival needs a chunk that does not decrease along it")
    order = order or [at]
    chunk = day_of(at) if chunk is None else chunk
    if order != [at]:
        seen = running(df, key, chunk, order, {"_top": ("max", F.col(at))}, inclusive=False)
        df = seen.filter(F.col("_top").isNull() | (F.col(at) >= F.col("_top"))).drop("_top")
    priced = df.filter(F.col(price).isNotNull())
    prior = running(priced, key, chunk, order, {"previous_price": ("last", F.col(price))}, inclusive=False)
    changed = prior.filter(F.col("previous_price").isNull() | (F.col(price) != F.col("previous_price")))
    return assess_price_change(changed, "previous_price", price, engagement)


def assess_price_change(df: DataFrame, previous: str, price: str, engagement: str | None = None) -> DataFrame:
    """Add direction, difference, alert threshold and whether the change is meaningful."""
    signed = F.col(price) - F.col(previous)
    threshold = F.greatest(F.lit(MIN_ALERT_CENTS), F.ceil(F.col(previous) * 0.01))
    tracked = F.lit(False)
    if engagement is not None:
        tracked = F.coalesce(F.col(engagement).isin("shortlisted", "contacted"), F.lit(False))
    drop = (signed < 0) & (F.abs(signed) >= threshold)
    return df.withColumns(
        {
            "direction": F.when(signed < 0, F.lit("decrease"))
            .when(signed > 0, F.lit("increase"))
            .when(signed == 0, F.lit("unchanged")),
            "difference_cents": F.abs(signed),
            "alert_threshold_cents": F.when(signed.isNotNull(), threshold.cast("bigint")),
            "meaningful": F.coalesce((signed != 0) & (tracked | drop), F.lit(False)),
        }
    ).withColumn("alertable", F.col("meaningful"))


def price_change_events(changes: DataFrame, key: str, at: str, price: str) -> DataFrame:
    """Events of real changes; the opening price of a listing is history but no event."""
    return changes.filter(F.col("previous_price").isNotNull()).select(
        F.col(key),
        F.concat(
            F.lit("price:"), F.col(key).cast("string"), F.lit(":"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        ).alias("event_key"),
        F.lit("price_changed").alias("type"),
        F.col(at).alias("occurred_at"),
        "meaningful",
        "alertable",
        "previous_price",
        F.col(price).alias("price"),
    )


def discovery_events(df: DataFrame, key: str, order: list[str], at: str, initial_scan: Column) -> DataFrame:
    """A new_listing event per listing; listings of a first scan are backlog and raise no alert."""
    marked = df.withColumn("_initial", initial_scan)
    first = first_per_key(marked, [key], order, [at, "_initial"])
    return first.select(
        key,
        F.concat(F.lit("new:"), F.col(key).cast("string")).alias("event_key"),
        F.lit("new_listing").alias("type"),
        F.col(at).alias("occurred_at"),
        F.when(F.col("_initial"), F.lit("initial_backlog")).otherwise(F.lit("monitoring")).alias("discovery_kind"),
        (~F.col("_initial")).alias("alertable"),
    )


STATE = [
    "first_seen_at",
    "last_seen_at",
    "consecutive_misses",
    "possibly_unavailable_at",
    "inactive_at",
    "sold_at",
]


def lifecycle_state(
    log: DataFrame,
    key: str,
    at: str,
    kind: str,
    order: list[str],
    previous: DataFrame | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """Current state per listing from a log of ``seen``, ``miss``, ``sweep`` and ``sold`` rows.

    Rules: the third miss in a row makes a listing doubtful, a day without a sighting after that
    inactive, a sighting revives it, sold is final. ``order`` starts with ``at``. ``previous`` is an
    earlier result; the log then holds only what came after it. Rows without key or time are left out.

    The log is read and shuffled once, by listing and ``chunk`` (a day, or what ``measured_chunks``
    gives for listings with very many rows; it must not decrease along ``order``). A chunk becomes a
    summary: first and last sight, first sale, last sight before that. Summaries of a listing are
    combined in order and tell each chunk which of its rows lie after the last sight; of those it
    keeps the number of misses, the first three, and the first overdue row, which combine likewise.
    """
    if order[0] != at:
        raise ValueError("the order of a lifecycle log starts with its time")
    rows = log.select(
        F.col(key), F.col(at).alias("at"), F.col(kind).alias("kind"), F.struct(*order).alias("place"), (day_of(at) if chunk is None else chunk).alias("_chunk")
    ).filter(F.col(key).isNotNull() & F.col("_chunk").isNotNull())
    # Dealt out by name, so that what the readings work out stays above the one shuffle they share.
    rows = rows.repartition(key, "_chunk")
    whole = _tails(rows, _sights(rows, key, previous), key)
    fresh = F.col("sight").isNotNull()
    frozen = F.col("p_sold_at").isNotNull()
    overdue, third = F.col("overdue"), F.col("third")
    doubt0, gone0 = F.when(~fresh, F.col("p_possibly_unavailable_at")), F.when(~fresh, F.col("p_inactive_at"))
    misses0 = _misses_before()
    # An overdue row before the third miss makes that miss the overdue one: times rise along the order.
    gone = F.when(misses0 >= MISSES_UNTIL_DOUBTFUL, overdue["at"]).when(third.isNotNull() & overdue.isNotNull(), F.greatest(overdue, third)["at"])
    state = whole.select(
        key,
        F.least("p_first_seen_at", "n_first").alias("first_seen_at"),
        F.greatest("p_last_seen_at", "n_last").alias("last_seen_at"),
        F.when(frozen, F.col("p_consecutive_misses")).otherwise(misses0 + F.coalesce("misses", F.lit(0))).cast("bigint").alias("consecutive_misses"),
        F.when(frozen, F.col("p_possibly_unavailable_at")).otherwise(F.coalesce(doubt0, third["at"])).alias("possibly_unavailable_at"),
        F.when(frozen, F.col("p_inactive_at")).otherwise(F.coalesce(gone0, gone)).alias("inactive_at"),
        F.coalesce("sold_at", "p_sold_at").alias("sold_at"),
    )
    if previous is not None:
        state = state.unionByName(previous.select(key, *STATE).join(rows.select(key), key, "left_anti"))
    return state.select(
        key,
        F.when(F.col("sold_at").isNotNull(), F.lit("sold"))
        .when(F.col("inactive_at").isNotNull(), F.lit("inactive"))
        .when(F.col("possibly_unavailable_at").isNotNull(), F.lit("possibly_unavailable"))
        .otherwise(F.lit("active"))
        .alias("availability"),
        *STATE,
    )


def _misses_before() -> Column:
    """Misses in a row that the earlier state brings along; a sighting in the log ends them."""
    return F.when(F.col("sight").isNull(), F.coalesce("p_consecutive_misses", F.lit(0))).otherwise(F.lit(0))


def _sights(rows: DataFrame, key: str, previous: DataFrame | None) -> DataFrame:
    """A summary of each chunk, with the listing's first sale and its last sight before that.

    Rows before the first sight of an unknown listing don't count, so a chunk keeps its first sale of
    all and its first sale after its first sight, and the last sight before either.
    """
    own, per = Window.partitionBy(key, "_chunk"), Window.partitionBy(key)
    place, seen, sold = F.col("place"), F.col("kind") == "seen", F.col("kind") == "sold"
    marked = rows.withColumns(
        {"s_first": F.min(F.when(seen, place)).over(own), "sold_any": F.min(F.when(sold, place)).over(own)}
    ).withColumn("sold_born", F.min(F.when(sold & (place > F.col("s_first")), place)).over(own))
    chunks = marked.groupBy(key, "_chunk").agg(
        F.min("s_first").alias("s_first"),
        F.max(F.when(seen, place)).alias("s_last"),
        F.min(F.when(seen, F.col("at"))).alias("s_min_at"),
        F.max(F.when(seen, F.col("at"))).alias("s_max_at"),
        F.min("sold_any").alias("sold_any"),
        F.min("sold_born").alias("sold_born"),
        F.max(F.when(sold, F.struct("place", "at"))).alias("sold_last"),
        F.max(F.when(seen & (place < F.col("sold_any")), place)).alias("seen_any"),
        F.max(F.when(seen & (place < F.col("sold_born")), place)).alias("seen_born"),
    )
    if previous is None:
        chunks = chunks.withColumns({f"p_{c}": F.lit(None).cast("bigint" if c == "consecutive_misses" else "timestamp") for c in STATE})
    else:
        chunks = chunks.join(previous.select(key, *[F.col(c).alias(f"p_{c}") for c in STATE]), key, "left")
    s_last, sold_place = F.col("s_last"), F.col("sold_place")
    return (
        chunks.withColumns({"known": F.col("p_first_seen_at").isNotNull(), "born": F.min("s_first").over(per)})
        .filter("known OR born IS NOT NULL")
        .withColumn("_sale", F.when(F.col("known") | (F.col("sold_any") > F.col("born")), F.col("sold_any")).otherwise(F.col("sold_born")))
        .withColumn("sold_place", F.min("_sale").over(per))
        .withColumn(
            "sight",
            F.max(
                F.when(sold_place.isNull() | (s_last < sold_place), s_last)
                .when(F.col("sold_any") == sold_place, F.col("seen_any"))
                .when(F.col("sold_born") == sold_place, F.col("seen_born"))
            ).over(per),
        )
    )


def _tails(rows: DataFrame, sights: DataFrame, key: str) -> DataFrame:
    """Per listing: its sights and sale, and of the rows after the last sight and before the sale the
    number of misses, the third miss in a row and the first overdue row.

    Rows meet the summary of their chunk where the first shuffle has put them; all its columns come
    along, so that the same shuffle serves both readings of the log.
    """
    place, at, kind = F.col("place"), F.col("at"), F.col("kind")
    living = F.col("p_sold_at").isNull() & (F.col("sight").isNull() | (place > F.col("sight"))) & (F.col("sold_place").isNull() | (place < F.col("sold_place")))
    seen_at = F.greatest(F.col(f"sight.{_first_field(rows)}"), F.col("p_last_seen_at"))
    miss = F.coalesce(living & (kind == "miss") & (at > F.col("seen_at")), F.lit(False))
    late = living & (miss | (kind == "sweep")) & (at.cast("double") - F.col("seen_at").cast("double") >= INACTIVE_AFTER_SECONDS)
    nth = Window.partitionBy(key, "_chunk").orderBy(F.when(F.col("is_miss"), 0).otherwise(1), "place")
    met = rows.join(sights.hint("merge"), [key, "_chunk"]).withColumn("seen_at", seen_at).withColumn("is_miss", miss)
    numbered = met.withColumn("_n", F.row_number().over(nth))
    carried = ["sight", "sold_place", "sold_last", "s_min_at", "s_max_at", *[f"p_{c}" for c in STATE]]
    chunks = numbered.groupBy(key, "_chunk").agg(
        *[F.first(c).alias(c) for c in carried],
        F.count_if("is_miss").alias("misses"),
        F.array_sort(F.collect_list(F.when(F.col("is_miss") & (F.col("_n") <= MISSES_UNTIL_DOUBTFUL), F.struct("place", "at")))).alias("early"),
        F.min(F.when(late, F.struct("place", "at"))).alias("overdue"),
    )
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    needed = F.lit(MISSES_UNTIL_DOUBTFUL) - _misses_before() - F.coalesce(F.sum("misses").over(before), F.lit(0))
    third = F.when((F.col("needed") >= 1) & (F.col("needed") <= F.col("misses")), F.try_element_at("early", F.col("needed").cast("int")))
    return (
        chunks.withColumn("needed", needed)
        .groupBy(key)
        .agg(
            F.min("s_min_at").alias("n_first"),
            F.max("s_max_at").alias("n_last"),
            F.max(F.when(F.col("sold_place").isNotNull(), F.col("sold_last")))["at"].alias("sold_at"),
            F.first("sight").alias("sight"),
            *[F.first(f"p_{c}").alias(f"p_{c}") for c in STATE],
            F.sum("misses").alias("misses"),
            F.min(third).alias("third"),
            F.min("overdue").alias("overdue"),
        )
    )


def _first_field(rows: DataFrame) -> str:
    return rows.schema["place"].dataType.names[0]


def expire_inactive(state: DataFrame, evaluated_at: Column) -> DataFrame:
    """Sweep stored states: doubtful for long enough becomes inactive."""
    overdue = evaluated_at.cast("double") - F.col("last_seen_at").cast("double") >= INACTIVE_AFTER_SECONDS
    due = (
        F.col("availability").isin("active", "possibly_unavailable")
        & (F.col("consecutive_misses") >= MISSES_UNTIL_DOUBTFUL)
        & overdue
    )
    return state.withColumns(
        {
            "availability": F.when(due, F.lit("inactive")).otherwise(F.col("availability")),
            "inactive_at": F.when(due, F.coalesce("inactive_at", evaluated_at)).otherwise(F.col("inactive_at")),
        }
    )


def mark_sold(state: DataFrame, sold: DataFrame, key: str = "listing_id") -> DataFrame:
    """Apply sold marks: ``sold`` has the key, sold_at and sold_reason."""
    marks = latest_per_key(sold, [key], ["sold_at"], ["sold_at", "sold_reason"]).withColumnsRenamed(
        {"sold_at": "_at", "sold_reason": "_why"}
    )
    joined = state.join(marks, key, "left")
    hit = F.col("_at").isNotNull()
    reason = F.col("sold_reason") if "sold_reason" in state.columns else F.lit(None).cast("string")
    return joined.withColumns(
        {
            "availability": F.when(hit, F.lit("sold")).otherwise(F.col("availability")),
            "sold_at": F.when(hit, F.col("_at")).otherwise(F.col("sold_at")),
            "sold_reason": F.when(hit, F.col("_why")).otherwise(reason),
        }
    ).drop("_at", "_why")


def _scan_places(links: DataFrame, observed: DataFrame, scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, points): the complete scans of each search numbered by time, and for each link the
    numbers at which it was there, from the last scan that was not after its first sight on, each with
    the number of the next such scan.

    Links and scans are merged by time and counted, so no link meets a scan that saw it.
    """
    full = scans.filter("complete_snapshot").select("search_id", "at").distinct()
    born = links.groupBy("listing_id", "search_id").agg(F.min("first_seen_at").alias("at"))
    marks = full.withColumns({"listing_id": F.lit(None).cast(links.schema["listing_id"].dataType), "is_link": F.lit(0)}).unionByName(
        born.withColumn("is_link", F.lit(1))
    )
    # A scan at the very time of the first sight comes before it: it does not expect the link.
    counted = running(marks, ["search_id"], day_of("at"), ["at", "is_link"], {"place": ("sum", 1 - F.col("is_link"))})
    places = counted.filter("is_link = 0").select("search_id", "at", "place")
    starts = counted.filter("is_link = 1").select("listing_id", "search_id", "place")
    seen = observed.select("listing_id", "search_id", "at").distinct().join(places, ["search_id", "at"])
    later = seen.join(starts.withColumnRenamed("place", "_start"), ["listing_id", "search_id"]).filter("place > _start")
    points = starts.unionByName(later.select("listing_id", "search_id", "place"))
    ends = places.groupBy("search_id").agg((F.max("place") + 1).alias("_end"))
    following = F.lead("place").over(Window.partitionBy("listing_id", "search_id").orderBy("place"))
    points = points.withColumn("_next", following).join(ends, "search_id").withColumn("next", F.coalesce("_next", "_end")).withColumn("last", F.col("_next").isNull())
    return places, points.select("listing_id", "search_id", "place", "next", "last")


def missed_listings(links: DataFrame, observed: DataFrame, scans: DataFrame) -> DataFrame:
    """Linked listings a complete scan did not see: listing_id, search_id, at.

    ``links``: listing_id, search_id, first_seen_at. ``observed``: listing_id, search_id, at.
    ``scans``: search_id, at, complete_snapshot; those of one batch, or of all time. The work grows
    with the links, the sights and what was missed, not with links times scans.
    """
    places, points = _scan_places(links, observed, scans)
    gaps = points.filter(F.col("next") > F.col("place") + 1)
    missed = gaps.select("listing_id", "search_id", F.explode(F.sequence(F.col("place") + 1, F.col("next") - 1)).alias("place"))
    return missed.join(places, ["search_id", "place"]).select("listing_id", "search_id", "at")


def misses_since_seen(links: DataFrame, observed: DataFrame, scans: DataFrame) -> DataFrame:
    """One row per link: how many complete scans in a row, up to the last one, did not see it."""
    _, points = _scan_places(links, observed, scans)
    counts = points.filter("last").select("listing_id", "search_id", (F.col("next") - F.col("place") - 1).alias("misses"))
    every = links.select("listing_id", "search_id").distinct().join(counts, ["listing_id", "search_id"], "left")
    return every.withColumn("misses", F.coalesce("misses", F.lit(0)).cast("bigint"))


def history_document(df: DataFrame, key: str, order: list[str], columns: list[str], name: str) -> DataFrame:
    """Sorted list of a key's rows, for detail views of one listing at a time."""
    item = F.struct(*order, *[c for c in columns if c not in order])
    return df.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(name))
