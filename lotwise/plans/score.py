"""Valuation of all listings for all their searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.operators import cohort as C
from lotwise.operators.classify import risk_flags
from lotwise.operators.matching import evaluate_criteria, fan_out, personal_fit
from lotwise.operators.recommend import recommendation
from lotwise.session import ensure_checkpoint_dir


def value_listings(
    resolved: DataFrame, evaluated_at: Column, rules: C.CohortRules = C.CohortRules(), wanted: DataFrame | None = None
) -> DataFrame:
    """Cohort, market value and confidence once per listing, whatever number of searches it has;
    only of ``wanted`` listings where these are named."""
    flagged = risk_flags(resolved)
    valued = C.cohort_summary(flagged, evaluated_at, rules, wanted)
    return C.valuation_confidence(C.market_value(valued), evaluated_at)


def score_all(
    resolved: DataFrame,
    links: DataFrame,
    searches: DataFrame,
    evaluated_at: Column,
    rules: C.CohortRules = C.CohortRules(),
) -> DataFrame:
    """One row per eligible (listing, search): value, fit, confidence and recommendation.

    ``resolved``: facts of :func:`lotwise.operators.overlay.resolve_listing` with title,
    description, card_facts, availability, last_seen_at, group_id. Inactive and sold listings
    are not scored; listings that a search excludes or cannot decide have no score for it.
    """
    alive = resolved.filter(~F.col("availability").isin("inactive", "sold"))
    ensure_checkpoint_dir(resolved.sparkSession)
    # Read several times by the valuation; the links, of which there are many more, are read for it only once.
    wanted = alive.select("listing_id").join(links.select("listing_id"), "listing_id", "left_semi").checkpoint()
    valued = value_listings(resolved, evaluated_at, rules, wanted)
    fanned = fan_out(valued, links, searches)
    matched = personal_fit(evaluate_criteria(fanned)).filter(F.col("match_status") == "matches")
    budget = F.try_element_at("criteria", F.lit("price_range"))
    ready = matched.withColumns(
        {
            "budget_min_eur": budget["minimum"],
            "budget_max_eur": budget["maximum"],
            "available": F.col("availability") == "active",
        }
    )
    return recommendation(ready, evaluated_at)
