"""A marketplace derived from the given tables: parts are listings, suppliers are saved searches,
line items say which search saw which listing.

Expressions that both engines read the same way are shared; the two forms differ only in dates
and arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.operators.matching import criteria_map, criterion

EVALUATED_AT = "2024-06-30 12:00:00"

LISTING = {
    "listing_id": "p_partkey",
    "make": "p_brand",
    "model": "p_type",
    "variant": "CASE WHEN p_partkey % 4 <> 0 THEN split_part(p_name, ' ', 1) END",
    "year": "CASE WHEN p_partkey % 61 <> 0 THEN 2000 + CAST(floor(p_size / 5) AS INT) END",
    "mileage": "CAST(p_size AS BIGINT) * 4000 + (p_partkey % 100) * 100",
    "fuel": "CASE WHEN p_partkey % 23 <> 0 THEN 'diesel' END",
    "gearbox": "'manual'",
    "power_hp": "CASE WHEN p_partkey % 5 <> 0 THEN 60 + p_size END",
    "seller_type": "CASE p_partkey % 3 WHEN 0 THEN 'dealer' WHEN 1 THEN 'private' END",
    "price_cents": "CASE WHEN p_partkey % 29 <> 0 THEN (CAST(round(p_retailprice * 1000) AS BIGINT)"
    " + (p_partkey * 7919) % 500000) * (CASE WHEN p_partkey % 37 = 0 THEN 5 ELSE 1 END) END",
    "price_interpretation": "CASE WHEN p_partkey % 29 <> 0 THEN 'full_price' ELSE 'unknown' END",
    "financing": "p_partkey % 41 = 0",
    "monthly_payment": "false",
    "deposit": "false",
    "damaged": "p_partkey % 31 = 0",
    "imported": "p_partkey % 43 = 0",
    "availability": "CASE WHEN p_partkey % 19 = 0 THEN 'inactive' WHEN p_partkey % 17 = 0 THEN 'possibly_unavailable'"
    " ELSE 'active' END",
    "group_id": "CASE WHEN p_partkey % 3 = 0 THEN concat('g', p_brand, p_type, CAST(floor(p_size / 10) AS INT)) END",
    "title": "concat(p_brand, ' ', p_type, ' ', p_name)",
    "description": "CASE WHEN p_partkey % 6 <> 0 THEN p_name END",
}

_AGE = "CASE WHEN p_partkey % 47 = 0 THEN -5 ELSE p_partkey % 120 END"


def listings(t) -> DataFrame:
    """Resolved listings."""
    seen = f"CASE WHEN p_partkey % 53 <> 0 THEN TIMESTAMP '{EVALUATED_AT}' - make_dt_interval(CAST({_AGE} AS INT)) END"
    df = t.part.selectExpr(
        *[f"{e} AS {n}" for n, e in LISTING.items()], f"{seen} AS last_seen_at", "array(p_type) AS card_facts"
    )
    return df.withColumn("year", F.col("year").cast("int"))


def evaluated_at():
    return F.lit(EVALUATED_AT).cast("timestamp")


_LISTING_SQL = ", ".join(f"{e} AS {n}" for n, e in LISTING.items())
LISTINGS_SQL = f"""
listings AS (
  SELECT {_LISTING_SQL},
    CASE WHEN p_partkey % 53 <> 0 THEN TIMESTAMP '{EVALUATED_AT}' - to_days(CAST({_AGE} AS INT)) END AS last_seen_at
  FROM part
),
flagged AS (
  SELECT *, (financing OR monthly_payment OR deposit OR coalesce(price_cents > 0 AND price_cents < 100000, false)) AS high_risk,
    CAST(financing AS INT) + CAST(monthly_payment AS INT) + CAST(deposit AS INT)
      + CAST(coalesce(price_cents > 0 AND price_cents < 100000, false) AS INT)
      + CAST(damaged AS INT) + CAST(imported AS INT) AS risk_count
  FROM listings
)"""

SEARCH = {
    "price_max": "9000 + (s_suppkey * 37) % 8000",
    "price_hard": "s_suppkey % 2 = 0",
    "min_year": "CASE WHEN s_suppkey % 3 = 0 THEN 2000 + s_suppkey % 8 END",
    "has_fuels": "s_suppkey % 4 = 1",
    "has_required": "s_suppkey % 5 = 0",
    "has_excluded": "s_suppkey % 7 = 0",
    "excluded_hard": "s_suppkey % 14 = 0",
    "has_make": "s_suppkey % 6 = 1",
    "min_power": "CASE WHEN s_suppkey % 2 = 1 THEN 80 + s_suppkey % 20 END",
    "has_seller": "s_suppkey % 3 = 1",
    "has_target": "s_suppkey % 13 = 0",
    "max_mileage": "CASE WHEN s_suppkey % 9 = 0 THEN 120000 END",
}


def searches(t) -> DataFrame:
    """Saved searches with their criteria."""
    s = t.supplier.selectExpr("s_suppkey AS search_id", *[f"{e} AS {n}" for n, e in SEARCH.items()])

    def strength(hard):
        return F.when(hard, F.lit("hard")).otherwise(F.lit("soft"))

    def words(*values):
        return F.array(*[F.lit(v) for v in values])

    criteria = criteria_map(
        model_target=F.when(F.col("has_target"), criterion("hard", words("Brand#4", "LARGE"))),
        make_keywords=F.when(F.col("has_make") & ~F.col("has_target"), criterion("hard", words("brand#1", "Brand#2"))),
        price_range=criterion(strength(F.col("price_hard")), maximum=F.col("price_max")),
        minimum_year=F.when(F.col("min_year").isNotNull(), criterion("hard", minimum=F.col("min_year"))),
        maximum_mileage=F.when(F.col("max_mileage").isNotNull(), criterion("soft", maximum=F.col("max_mileage"))),
        fuels=F.when(F.col("has_fuels"), criterion("soft", words("diesel", "petrol"))),
        minimum_power=F.when(F.col("min_power").isNotNull(), criterion("soft", minimum=F.col("min_power"))),
        seller=F.when(F.col("has_seller"), criterion("soft", words("dealer"))),
        required_keywords=F.when(F.col("has_required"), criterion("hard", words("RING"))),
        excluded_keywords=F.when(
            F.col("has_excluded"), criterion(strength(F.col("excluded_hard")), words("bolt", "gear"))
        ),
    )
    return s.select("search_id", criteria.alias("criteria"))


def links(t) -> DataFrame:
    """Which search saw which listing, first and last."""
    return t.lineitem.groupBy(F.col("l_partkey").alias("listing_id"), F.col("l_suppkey").alias("search_id")).agg(
        F.min("l_shipdate").alias("first_seen_at"), F.max("l_shipdate").alias("last_seen_at")
    )


_SEARCH_SQL = ", ".join(f"{e} AS {n}" for n, e in SEARCH.items())

MATCH_SQL = f"""
searches AS (SELECT s_suppkey AS search_id, {_SEARCH_SQL} FROM supplier),
links AS (SELECT DISTINCT l_partkey AS listing_id, l_suppkey AS search_id FROM lineitem),
fanned AS (
  SELECT f.*, s.*, lower(concat_ws(' ', title, description, model)) AS body
  FROM flagged f JOIN links USING (listing_id) JOIN searches s USING (search_id)
),
judged AS (
  SELECT *,
    CASE WHEN has_target THEN (lower(make) = 'brand#4' AND lower(model) = 'large') END AS m_target,
    CASE WHEN has_make AND NOT has_target THEN (contains(lower(make), 'brand#1') OR contains(lower(make), 'brand#2')) END AS m_make,
    CASE WHEN price_cents IS NOT NULL THEN price_cents <= price_max * 100 END AS m_price,
    year >= min_year AS m_year,
    mileage <= max_mileage AS m_mileage,
    CASE WHEN has_fuels THEN fuel IN ('diesel', 'petrol') END AS m_fuel,
    power_hp >= min_power AS m_power,
    CASE WHEN has_seller THEN seller_type = 'dealer' END AS m_seller,
    CASE WHEN has_required THEN
      CASE WHEN contains(body, 'ring') THEN true WHEN description IS NOT NULL THEN false END END AS m_required,
    CASE WHEN has_excluded THEN NOT (contains(body, 'bolt') OR contains(body, 'gear')) END AS m_excluded
  FROM fanned
),
counted AS (
  SELECT *,
    CAST(coalesce(NOT m_target, false) AS INT) + CAST(coalesce(NOT m_make, false) AS INT)
      + CAST(coalesce(price_hard AND NOT m_price, false) AS INT) + CAST(coalesce(NOT m_year, false) AS INT)
      + CAST(coalesce(NOT m_required, false) AS INT) + CAST(coalesce(excluded_hard AND NOT m_excluded, false) AS INT) AS failures,
    CAST(price_hard AND m_price IS NULL AS INT) + CAST(min_year IS NOT NULL AND m_year IS NULL AS INT)
      + CAST(has_required AND m_required IS NULL AS INT) AS missing,
    CAST(NOT price_hard AS INT) + CAST(max_mileage IS NOT NULL AS INT) + CAST(has_fuels AS INT)
      + CAST(min_power IS NOT NULL AS INT) + CAST(has_seller AS INT) + CAST(has_excluded AND NOT excluded_hard AS INT) AS soft,
    CAST(coalesce(NOT price_hard AND m_price, false) AS INT) + CAST(coalesce(m_mileage, false) AS INT)
      + CAST(coalesce(m_fuel, false) AS INT) + CAST(coalesce(m_power, false) AS INT) + CAST(coalesce(m_seller, false) AS INT)
      + CAST(coalesce(has_excluded AND NOT excluded_hard AND m_excluded, false) AS INT) AS fit_matched,
    CAST(coalesce(NOT price_hard AND NOT m_price, false) AS INT) + CAST(coalesce(NOT m_mileage, false) AS INT)
      + CAST(coalesce(NOT m_fuel, false) AS INT) + CAST(coalesce(NOT m_power, false) AS INT)
      + CAST(coalesce(NOT m_seller, false) AS INT)
      + CAST(coalesce(has_excluded AND NOT excluded_hard AND NOT m_excluded, false) AS INT) AS fit_missed
  FROM judged
),
matched AS (
  SELECT *, CASE WHEN failures > 0 THEN 'excluded' WHEN missing > 0 THEN 'needs_information' ELSE 'matches' END AS match_status,
    CASE WHEN fit_matched + fit_missed > 0 THEN CAST(floor(100.0 * fit_matched / (fit_matched + fit_missed) + 0.5) AS INT) END AS fit_percent
  FROM counted
)"""

COHORT_SQL = f"""
history AS (
  SELECT *, coalesce(last_seen_at <= TIMESTAMP '{EVALUATED_AT}' AND last_seen_at >= TIMESTAMP '{EVALUATED_AT}' - INTERVAL 30 DAY, false) AS recent
  FROM flagged
  WHERE availability = 'active' AND NOT high_risk AND price_interpretation = 'full_price'
    AND price_cents BETWEEN 100000 AND 100000000 AND NOT damaged AND NOT financing AND NOT monthly_payment AND NOT deposit
    AND make IS NOT NULL AND model IS NOT NULL AND year IS NOT NULL AND mileage IS NOT NULL AND fuel IS NOT NULL AND gearbox IS NOT NULL
    AND (last_seen_at IS NULL OR (last_seen_at <= TIMESTAMP '{EVALUATED_AT}' AND last_seen_at >= TIMESTAMP '{EVALUATED_AT}' - INTERVAL 90 DAY))
),
paired AS (
  SELECT s.listing_id, h.listing_id AS member_id, h.price_cents AS price, h.group_id, h.last_seen_at, h.variant, h.recent
  FROM flagged s JOIN history h
    ON s.make = h.make AND s.model = h.model AND s.fuel = h.fuel AND s.gearbox = h.gearbox
   AND abs(s.year - h.year) <= 2 AND abs(s.mileage - h.mileage) <= 40000
   AND (s.variant IS NULL OR h.variant IS NULL OR lower(s.variant) = lower(h.variant))
   AND s.listing_id <> h.listing_id
   AND NOT coalesce(s.availability = 'active' AND s.group_id = h.group_id, false)
),
single AS (
  SELECT * FROM paired
  QUALIFY row_number() OVER (PARTITION BY listing_id, coalesce(group_id, 'l:' || member_id)
    ORDER BY last_seen_at DESC NULLS LAST, member_id) = 1
),
bounds AS (
  SELECT listing_id, count(*) AS n, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3,
    floor(quantile_cont(price, 0.5) + 0.5) AS mid
  FROM single GROUP BY listing_id
),
marked AS (
  SELECT s.*, n, (n < 5 OR price BETWEEN CASE WHEN q3 = q1 THEN mid * 0.5 ELSE q1 - 1.5 * (q3 - q1) END
                              AND CASE WHEN q3 = q1 THEN mid * 1.5 ELSE q3 + 1.5 * (q3 - q1) END) AS inside
  FROM single s JOIN bounds USING (listing_id)
),
summed AS (
  SELECT listing_id, count(*) AS candidate_count, count(*) FILTER (inside) AS comparable_count,
    count(*) FILTER (inside AND recent) AS recent_count, count(*) FILTER (inside AND variant IS NULL) AS no_variant_count,
    quantile_cont(price, 0.25) FILTER (inside) AS q1, quantile_cont(price, 0.5) FILTER (inside) AS q2, quantile_cont(price, 0.75) FILTER (inside) AS q3
  FROM marked GROUP BY listing_id
),
valued AS (
  SELECT f.*, coalesce(candidate_count, 0) AS candidate_count, coalesce(comparable_count, 0) AS comparable_count,
    coalesce(recent_count, 0) AS recent_count, coalesce(no_variant_count, 0) AS no_variant_count,
    CASE WHEN comparable_count >= 5 THEN CAST(floor(q2 + 0.5) AS BIGINT) END AS median_cents,
    CASE WHEN comparable_count >= 5 THEN CAST(floor(q1 + 0.5) AS BIGINT) END AS lower_cents,
    CASE WHEN comparable_count >= 5 THEN CAST(floor(q3 + 0.5) AS BIGINT) END AS upper_cents
  FROM flagged f LEFT JOIN summed USING (listing_id)
),
priced AS (
  SELECT *, CASE WHEN high_risk OR price_interpretation <> 'full_price' OR price_cents IS NULL OR price_cents <= 0
      OR coalesce(price_cents < median_cents * 0.5, false) THEN 'verify_price'
    WHEN median_cents IS NULL THEN 'insufficient_data' ELSE 'available' END AS market_status
  FROM valued
),
market AS (
  SELECT *,
    CASE WHEN market_status = 'available' THEN floor(CAST(median_cents - price_cents AS DOUBLE) / median_cents * 100 * 10 + 0.5) / 10 END AS discount_percent,
    CASE WHEN market_status = 'available' THEN
      CASE WHEN price_cents < lower_cents THEN 'below_range' WHEN price_cents > upper_cents THEN 'above_range' ELSE 'within_range' END END AS position,
    floor(CAST(upper_cents - lower_cents AS DOUBLE) / median_cents * 100 * 10 + 0.5) / 10 AS price_spread_percent,
    CAST(make IS NOT NULL AS INT) + CAST(model IS NOT NULL AS INT) + CAST(year IS NOT NULL AS INT) + CAST(mileage IS NOT NULL AS INT)
      + CAST(fuel IS NOT NULL AS INT) + CAST(gearbox IS NOT NULL AS INT) + CAST(power_hp IS NOT NULL AS INT)
      + CAST(seller_type IS NOT NULL AS INT) + CAST(price_interpretation = 'full_price' AND price_cents IS NOT NULL AS INT) AS known_facts,
    (last_seen_at IS NULL OR last_seen_at > TIMESTAMP '{EVALUATED_AT}' OR last_seen_at < TIMESTAMP '{EVALUATED_AT}' - INTERVAL 30 DAY) AS stale_subject
  FROM priced
),
confident AS (
  SELECT *, CASE
    WHEN market_status <> 'available' OR known_facts < 6 OR stale_subject OR coalesce(price_spread_percent > 40, false) THEN 'low'
    WHEN comparable_count >= 10 AND known_facts >= 8 AND recent_count = comparable_count AND coalesce(price_spread_percent <= 20, false)
      AND variant IS NOT NULL AND no_variant_count = 0 THEN 'high'
    ELSE 'medium' END AS confidence
  FROM market
)"""

SCORE_SQL = f"""
scored AS (
  SELECT c.*, m.search_id, m.price_max, m.match_status, m.fit_percent, m.fit_matched, m.fit_missed, m.soft,
    CASE WHEN c.last_seen_at <= TIMESTAMP '{EVALUATED_AT}' THEN date_diff('day', c.last_seen_at, TIMESTAMP '{EVALUATED_AT}') END AS age_days
  FROM confident c JOIN matched m USING (listing_id)
  WHERE c.availability NOT IN ('inactive', 'sold') AND m.match_status = 'matches'
),
banded AS (
  SELECT *, CASE
    WHEN coalesce(price_cents > price_max * 100, false) OR availability <> 'active' THEN 'not_recommended'
    WHEN coalesce(price_cents, 0) <= 0 OR risk_count > 0 OR market_status = 'verify_price' OR age_days IS NULL OR age_days > 30 THEN 'needs_verification'
    WHEN market_status <> 'available' THEN 'insufficient_data'
    WHEN confidence = 'low' OR year IS NULL OR mileage IS NULL THEN 'needs_verification'
    WHEN coalesce(discount_percent, 0) >= 10 AND position = 'below_range' THEN 'strong_candidate'
    ELSE 'worth_reviewing' END AS band
  FROM scored
),
ranked AS (
  SELECT *, (CASE band WHEN 'not_recommended' THEN 0 WHEN 'needs_verification' THEN 1 WHEN 'insufficient_data' THEN 2
      WHEN 'worth_reviewing' THEN 3 ELSE 4 END) * 1000000
    + (CASE WHEN market_status = 'available' THEN greatest(-100.0, least(100.0, discount_percent)) ELSE 0.0 END + 100) * 1000
    + (CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) * 100 + known_facts * 5
    + (30 - least(30, coalesce(age_days, 30)))
    + (100 - CASE WHEN year IS NULL THEN 100 ELSE greatest(0, least(100, 2024 - year)) END) / 100.0
    + (3000000 - greatest(0, least(3000000, coalesce(mileage, 3000000)))) / 3000000.0 AS raw_key
  FROM banded
)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",".join(parts)
