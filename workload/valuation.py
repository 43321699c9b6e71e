"""Cohorts, market value, confidence, recommendations and ranked lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions.numbers import round_half_up
from lotwise.operators import cohort as C
from lotwise.operators.classify import risk_flags
from lotwise.operators.quality import assessment_issues
from lotwise.operators.rank import best_deal_topk, inbox_topk, rank_members, ranked_scores, top_score_per_listing
from lotwise.plans.score import score_all, value_listings
from workload import query
from workload import market as M

_VALUED = M.with_sql(M.LISTINGS_SQL, M.COHORT_SQL)
_SCORED = M.with_sql(M.LISTINGS_SQL, M.MATCH_SQL, M.COHORT_SQL, M.SCORE_SQL)


def _flagged(t):
    return risk_flags(M.listings(t))


@query(
    "cohort_valuation",
    _VALUED
    + """ SELECT listing_id, candidate_count, comparable_count, recent_count, median_cents, lower_cents, upper_cents,
      market_status, discount_percent, position FROM market""",
)
def cohort_valuation(t):
    """Every listing against its cohort: size, quartiles, status, discount and position."""
    valued = C.market_value(C.cohort_summary(_flagged(t), M.evaluated_at()))
    return valued.select(
        "listing_id",
        "candidate_count",
        "comparable_count",
        "recent_count",
        "median_cents",
        "lower_cents",
        "upper_cents",
        "market_status",
        "discount_percent",
        "position",
    )


@query(
    "cohort_members",
    _VALUED
    + """ SELECT listing_id, member_id, price AS price_cents, NOT inside AS outlier,
      row_number() OVER (PARTITION BY listing_id, inside ORDER BY price, member_id) - 1 AS rank FROM marked""",
)
def cohort_members(t):
    """Comparables of every listing with outlier mark and rank."""
    return C.cohort_members(_flagged(t), M.evaluated_at()).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "cohort_outliers",
    _VALUED
    + """ SELECT listing_id, count(*) AS outliers, min(member_id) AS first_outlier, max(member_id) AS last_outlier
      FROM marked WHERE NOT inside GROUP BY listing_id""",
)
def cohort_outliers(t):
    """Comparables left out as price outliers."""
    members = C.cohort_members(_flagged(t), M.evaluated_at())
    return members.filter("outlier").groupBy("listing_id").agg(
        F.count("*").alias("outliers"), F.min("member_id").alias("first_outlier"), F.max("member_id").alias("last_outlier")
    )


_FRESH_SQL = """
WITH offers AS (
  SELECT l_orderkey * 10 + l_linenumber AS offer_id, l_partkey AS part, l_suppkey AS seller,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS price, l_shipdate AS seen, l_quantity AS quantity
  FROM lineitem
), latest AS (SELECT max(seen) AS now FROM offers),
fresh AS (SELECT offers.*, now FROM offers, latest WHERE seen <= now AND seen >= now - INTERVAL 365 DAY),
single AS (SELECT part, seller, arg_max(price, (seen, -offer_id)) AS price FROM fresh GROUP BY part, seller)
SELECT part, count(*) AS sellers, CAST(floor(quantile_cont(price, 0.5) + 0.5) AS BIGINT) AS median_price,
  floor(quantile_cont(price, 0.25) * 100 + 0.5) / 100 AS lower_price, floor(quantile_cont(price, 0.75) * 100 + 0.5) / 100 AS upper_price
FROM single GROUP BY part"""


@query("cohort_fresh", _FRESH_SQL)
def cohort_fresh(t):
    """Fresh offers per part, one per seller, with median and quartiles."""
    offers = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offer_id"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("seller"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price"),
        F.col("l_shipdate").alias("seen"),
    )
    # One row: the newest time in the table.
    now = offers.agg(F.max("seen").alias("now"))
    fresh = offers.join(F.broadcast(now), (F.col("seen") <= F.col("now")) & (F.col("seen") >= F.col("now") - F.expr("INTERVAL 365 DAYS")))
    single = fresh.groupBy("part", "seller").agg(F.max(F.struct("seen", (-F.col("offer_id")).alias("o"), "price"))["price"].alias("price"))
    q = F.percentile("price", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return single.groupBy("part").agg(F.count("*").alias("sellers"), q.alias("q")).select(
        "part",
        "sellers",
        C.median_rounded(F.col("q")[1]).alias("median_price"),
        round_half_up(F.col("q")[0], 2).alias("lower_price"),
        round_half_up(F.col("q")[2], 2).alias("upper_price"),
    )


@query(
    "confidence_levels",
    _VALUED
    + """ SELECT listing_id, confidence, CAST(known_facts AS INT) AS known_facts, price_spread_percent,
      (variant IS NULL OR no_variant_count > 0) AS missing_variants, stale_subject FROM confident""",
)
def confidence_levels(t):
    """Confidence of every valuation."""
    return value_listings(M.listings(t), M.evaluated_at()).select(
        "listing_id", "confidence", "known_facts", "price_spread_percent", "missing_variants", "stale_subject"
    )


def _scores(t):
    return score_all(M.listings(t), M.links(t), M.searches(t), M.evaluated_at())


@query(
    "recommendation_bands",
    _SCORED
    + """ SELECT listing_id, search_id, band, confidence, market_status, discount_percent, fit_percent,
      floor(raw_key * 10000 + 0.5) / 10000 AS ordering_key FROM ranked""",
)
def recommendation_bands(t):
    """Recommendation of every eligible listing and search."""
    return _scores(t).select(
        "listing_id",
        "search_id",
        "band",
        "confidence",
        "market_status",
        "discount_percent",
        "fit_percent",
        round_half_up(F.col("ordering_key"), 4).alias("ordering_key"),
    )


@query(
    "best_deal_topk",
    _SCORED
    + """ SELECT listing_id, search_id, band, floor(raw_key * 10000 + 0.5) / 10000 AS ordering_key FROM (
      SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY raw_key DESC, search_id) AS n FROM ranked) WHERE n = 1
      ORDER BY raw_key DESC NULLS LAST, last_seen_at DESC NULLS LAST, listing_id DESC LIMIT 250""",
)
def best_deal_topk_query(t):
    """Best recommendation of each listing; the first 250 listings."""
    best = _scores(t).groupBy("listing_id").agg(
        F.max(F.struct("ordering_key", (-F.col("search_id")).alias("s"), "band", "last_seen_at")).alias("b")
    ).select("listing_id", (-F.col("b.s")).alias("search_id"), "b.band", "b.ordering_key", "b.last_seen_at")
    return best_deal_topk(best).select(
        "listing_id", "search_id", "band", round_half_up(F.col("ordering_key"), 4).alias("ordering_key")
    )


@query(
    "top_score_per_listing",
    _SCORED
    + """ SELECT listing_id, search_id, fit_percent AS sort_value FROM (
      SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY fit_percent DESC NULLS LAST, search_id) AS n FROM ranked) WHERE n = 1""",
)
def top_score(t):
    """Search that fits each listing best."""
    return top_score_per_listing(_scores(t), F.col("fit_percent"))


@query(
    "ranked_scores",
    _SCORED
    + """ SELECT search_id, listing_id, discount_percent, fit_percent, row_number() OVER (PARTITION BY search_id
      ORDER BY discount_percent DESC NULLS LAST, fit_percent DESC NULLS LAST, listing_id) - 1 AS rank FROM ranked""",
)
def ranked(t):
    """Scores of each search in rank order."""
    scores = _scores(t).select("search_id", "listing_id", "discount_percent", "fit_percent")
    order = [F.col("discount_percent").desc_nulls_last(), F.col("fit_percent").desc_nulls_last(), F.col("listing_id")]
    return rank_members(scores, ["search_id"], order).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "search_ranking",
    _SCORED
    + """ SELECT listing_id, discount_percent, fit_percent FROM ranked WHERE search_id = 1""",
)
def search_ranking(t):
    """One search's scores, best first."""
    mine = M.searches(t).filter("search_id = 1")
    scores = score_all(M.listings(t), M.links(t).filter("search_id = 1"), mine, M.evaluated_at())
    return ranked_scores(scores).select("listing_id", "discount_percent", "fit_percent")


_TOP = """ SELECT listing_id, rank_value FROM (
  SELECT l.listing_id, l.last_seen_at, max({value}) AS rank_value FROM listings l LEFT JOIN ranked r USING (listing_id)
  GROUP BY l.listing_id, l.last_seen_at)
  ORDER BY rank_value DESC NULLS LAST, last_seen_at DESC NULLS LAST, listing_id DESC LIMIT 250"""

for _sort, _value in (
    ("market_value", "discount_percent"),
    ("personal_fit", "fit_percent"),
    ("confidence", "CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END"),
):

    def _inbox(t, sort=_sort):
        return inbox_topk(M.listings(t), _scores(t), sort).select("listing_id", "rank_value")

    query(f"inbox_topk_{_sort}", _SCORED + _TOP.format(value=_value))(_inbox)


@query(
    "inbox_topk_recent",
    M.with_sql(M.LISTINGS_SQL)
    + " SELECT listing_id, title FROM listings ORDER BY last_seen_at DESC NULLS LAST, listing_id DESC LIMIT 250",
)
def inbox_recent(t):
    """Newest listings first."""
    return inbox_topk(M.listings(t)).select("listing_id", "title")


@query(
    "assessment_consistency",
    _SCORED + " SELECT CAST(count(*) AS BIGINT) AS scores, CAST(0 AS BIGINT) AS inconsistent FROM ranked",
)
def assessment_consistency(t):
    """Invariants between cohort and score hold for every row."""
    checked = assessment_issues(_scores(t))
    return checked.agg(F.count("*").alias("scores"), F.count_if(F.size("issues") > 0).alias("inconsistent"))


@query(
    "valuation_texts",
    _SCORED
    + """ SELECT listing_id, search_id,
      CAST(3 + CAST(price_spread_percent IS NOT NULL AS INT) + CAST(comparable_count < 5 AS INT)
        + CAST(variant IS NULL OR no_variant_count > 0 AS INT) + CAST(stale_subject AS INT) + CAST(market_status = 'verify_price' AS INT) AS INT) AS confidence_reasons,
      CASE WHEN market_status = 'verify_price' THEN 'Price or condition looks odd; check both before calling it cheap.'
        WHEN market_status = 'insufficient_data' THEN 'Too few to compare: ' || comparable_count || ' similar vehicles, 5 needed.'
        ELSE 'Half of the similar offers, outliers left out, lie inside this range; sold prices may differ.' END AS market_text,
      CASE WHEN soft = 0 THEN 'The search names no wishes.' ELSE
        fit_matched || ' met, ' || fit_missed || ' not met, ' || (soft - fit_matched - fit_missed) ||
        ' open. Only wishes that can be judged count; distance does not.' END AS fit_text FROM ranked""",
)
def valuation_texts(t):
    """Explanations that go with each score."""
    return _scores(t).select(
        "listing_id",
        "search_id",
        F.size("confidence_reasons").alias("confidence_reasons"),
        F.col("market_explanation").alias("market_text"),
        F.col("fit_explanation").alias("fit_text"),
    )
