"""Inbox filters, ranked lists and work batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators.ordered import CHUNK_ROWS, measured_chunks, running
from lotwise.session import ensure_checkpoint_dir

INBOX_SIZE = 250


def text_query(query: str, *columns: str) -> Column:
    """Case-insensitive literal search in any of the columns."""
    needle = query.strip().lower()
    return reduce(
        lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(needle)), F.lit(False)) for c in columns]
    )


def under_budget(price: Column, maximum_eur: Column) -> Column:
    return F.coalesce(price <= maximum_eur * 100, F.lit(False))


def inbox_join(
    listings: DataFrame, reviews: DataFrame, facts: DataFrame, risk: DataFrame, classification: DataFrame
) -> DataFrame:
    """Listings with their review and, where present, facts, risk and classification; one key throughout."""
    return (
        listings.join(reviews, "listing_id")
        .join(facts, "listing_id", "left")
        .join(risk, "listing_id", "left")
        .join(classification, "listing_id", "left")
    )


def inbox_filter(
    df: DataFrame,
    matches: DataFrame,
    links: DataFrame | None = None,
    *,
    archived: bool = False,
    state: str | None = None,
    source: str | None = None,
    risk_only: bool = False,
    query: str | None = None,
    search_id=None,
    budget_eur: int | None = None,
) -> DataFrame:
    """Visible listings: not archived, not ruled out by title, with a match that is not excluded."""
    rules = [F.col("archived") == archived, F.coalesce(F.col("decision") != "exclude", F.lit(True))]
    if state is not None:
        rules.append(F.col("state") == state)
    if source is not None:
        rules.append(F.col("source") == source)
    if risk_only:
        rules.append(F.coalesce(F.col("high_risk"), F.lit(False)))
    if query and query.strip():
        rules.append(text_query(query, "title", "make", "model"))
    if budget_eur is not None:
        rules.append(under_budget(F.col("price_cents"), F.lit(budget_eur)))
    visible = matches.filter(F.col("match_status") != "excluded")
    if search_id is not None:
        visible = visible.filter(F.col("search_id") == search_id)
        if links is not None:
            df = df.join(links.filter(F.col("search_id") == search_id).select("listing_id"), "listing_id", "left_semi")
    kept = df.filter(reduce(lambda a, b: a & b, rules))
    return kept.join(visible.select("listing_id"), "listing_id", "left_semi")


def sort_value(sort: str) -> Column | None:
    """Score a listing is ranked by; None sorts by time only."""
    level = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    return {
        "best_deal": F.col("ordering_key"),
        "market_value": F.col("discount_percent"),
        "personal_fit": F.col("fit_percent"),
        "confidence": level,
        "recent": None,
    }[sort]


def inbox_topk(df: DataFrame, scores: DataFrame | None = None, sort: str = "recent", size: int = INBOX_SIZE) -> DataFrame:
    """First page: by the listing's best score, then last seen, then id, newest first."""
    value = sort_value(sort)
    if value is None or scores is None:
        ranked, order = df, []
    else:
        best = scores.groupBy("listing_id").agg(F.max(value).alias("rank_value"))
        ranked, order = df.join(best, "listing_id", "left"), [F.col("rank_value").desc_nulls_last()]
    return ranked.orderBy(*order, F.col("last_seen_at").desc(), F.col("listing_id").desc()).limit(size)


def best_deal_topk(df: DataFrame, size: int = INBOX_SIZE) -> DataFrame:
    """Best recommendation first; the whole set is ranked before the page is cut."""
    return df.orderBy(F.col("ordering_key").desc_nulls_last(), F.col("last_seen_at").desc(), F.col("listing_id").desc()).limit(size)


def ranked_scores(scores: DataFrame) -> DataFrame:
    """Scores of a search by discount and fit."""
    return scores.orderBy(
        F.col("discount_percent").desc_nulls_last(), F.col("fit_percent").desc_nulls_last(), F.col("listing_id")
    )


def top_score_per_listing(scores: DataFrame, value: Column) -> DataFrame:
    """Best score of each listing; equal values go to the smallest search id."""
    best = F.max(F.struct(value.alias("v"), (-F.col("search_id")).alias("s")))
    return scores.groupBy("listing_id").agg(best.alias("b")).select(
        "listing_id", (-F.col("b.s")).alias("search_id"), F.col("b.v").alias("sort_value")
    )


def next_capture_batch(
    listings: DataFrame,
    matches: DataFrame,
    scores: DataFrame,
    details: DataFrame,
    attempts: DataFrame,
    excluded: DataFrame,
    now: Column,
    fresh_before: Column,
    by_recommendation: bool = False,
    size: int = 5,
) -> DataFrame:
    """Per search, the listings whose detail page is captured next."""
    best = scores.groupBy("listing_id", "search_id").agg(
        F.max("fit_percent").alias("fit_percent"), F.max("ordering_key").alias("ordering_key")
    )
    allowed = ["matches"] if by_recommendation else ["matches", "needs_information"]
    open_ = (
        listings.filter(F.col("availability") == "active")
        .join(matches.filter(F.col("match_status").isin(*allowed)), "listing_id")
        .join(excluded.select("listing_id"), "listing_id", "left_anti")
        .join(details.select("listing_id", "captured_at"), "listing_id", "left")
        .join(attempts.select("listing_id", "state", "next_attempt_at"), "listing_id", "left")
        .filter(
            (F.col("captured_at").isNull() | (F.col("captured_at") < fresh_before))
            & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
            & (F.col("state").isNull() | (F.col("state") != "processing"))
        )
        .join(best, ["listing_id", "search_id"], "left")
    )
    first = [F.coalesce("ordering_key", F.lit(-1.0)).desc()] if by_recommendation else []
    order = Window.partitionBy("search_id").orderBy(
        *first,
        F.when(F.col("match_status") == "needs_information", 0).otherwise(1),
        F.coalesce("fit_percent", F.lit(-1)).desc(),
        F.col("last_seen_at").desc(),
        F.col("listing_id"),
    )
    # A rank limit is applied before the shuffle, so a search with very many listings sends few.
    return open_.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def next_work_batch(queue: DataFrame, excluded: DataFrame, control: DataFrame, now: Column, size: int = 1) -> DataFrame:
    """Oldest queued work that is due, unless work is paused.

    ``control`` has one row: switch and state; every queue row names the switch it obeys.
    """
    active = control.filter(F.col("state") == "active").select("switch").limit(1)
    due = queue.filter((F.col("state") == "queued") & (F.col("available_at") <= now))
    allowed = due.join(excluded.select("listing_id"), "listing_id", "left_anti")
    open_ = allowed.join(F.broadcast(active), "switch", "left_semi")
    return open_.orderBy("requested_at", "listing_id").limit(size)


def search_order(searches: DataFrame) -> DataFrame:
    return searches.orderBy("priority", "created_at", "search_id")


def renumber_priorities(searches: DataFrame, order: list[str], ident: str = "search_id") -> DataFrame:
    """Dense new priorities of the whole set in the given order, ties by ``ident``.

    Rows are dealt out by ranges of the order; each range starts where the ones before it end.
    """
    order = [*order, *[ident] * (ident not in order)]
    dealt = searches.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ensure_checkpoint_dir(searches.sparkSession)
    # Written, so that the ranges stay what they are when a task runs again.
    dealt = dealt.checkpoint()
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(starts, "_range").withColumn("priority", (inside + F.col("_before")).cast("int")).drop("_range", "_before")


def rank_members(df: DataFrame, group: list[str], order: list, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add rank, starting at 0, inside each group.

    ``order`` tells the rows of a group apart. Groups are cut into chunks of ``chunk_rows``, so that no
    task sorts a whole one; a row's place is its place in the chunk and the rows of the chunks before.
    """
    parts = measured_chunks(df, group, order, chunk_rows)
    return running(parts, group, F.col("_part"), order, {"rank": ("sum", F.lit(1))}, inclusive=False).drop("_part")


def summary_counts(df: DataFrame, **flags: Column) -> DataFrame:
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()])
