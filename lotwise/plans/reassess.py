"""After a correction: facts, risk, matches, work and scores of the listings it touches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.operators.classify import risk_flags
from lotwise.operators.matching import evaluate_criteria, fan_out
from lotwise.operators.overlay import overlay_corrections


@dataclass
class Reassessed:
    """What a set of corrections changes."""

    facts: DataFrame
    matches: DataFrame
    requests: DataFrame
    scores: DataFrame


def correct_and_reassess(
    facts: DataFrame, corrections: DataFrame, made: DataFrame, links: DataFrame, searches: DataFrame, scores: DataFrame
) -> Reassessed:
    """Apply the corrections ``made`` on top of the earlier ``corrections``.

    Only listings with a new correction are worked on: their effective facts and risk, their match
    with every search that saw them, one request each for the enrichment queue (its version is the
    time of the last correction), and the stored scores without theirs.
    """
    touched = made.groupBy("listing_id").agg(F.max("created_at").alias("corrected_at"))
    keys = touched.select("listing_id")
    known = corrections.join(keys, "listing_id", "left_semi").unionByName(made)
    corrected = risk_flags(overlay_corrections(facts.join(keys, "listing_id", "left_semi"), known))
    own_links = links.join(keys, "listing_id", "left_semi")
    at = F.col("corrected_at").cast("timestamp")
    requests = touched.select(
        "listing_id", at.alias("at"), F.lit(0).cast("bigint").alias("seq"), F.lit("enqueue").alias("kind"), F.unix_micros(at).alias("version"), F.lit(None).cast("string").alias("failure")
    )
    return Reassessed(
        facts=corrected,
        matches=evaluate_criteria(fan_out(corrected, own_links, searches)),
        requests=requests,
        scores=scores.join(keys, "listing_id", "left_anti"),
    )
