"""Localities to coordinates and listing distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions.geo import approximate_km, distance_label
from lotwise.functions.text import locality_key

# Centroids of localities.
CENTROIDS = {
    "lisboa": (38.7223, -9.1393),
    "porto": (41.1579, -8.6291),
    "setubal": (38.5244, -8.8882),
    "sintra": (38.8029, -9.3817),
    "cascais": (38.6968, -9.4215),
    "almada": (38.6765, -9.1651),
    "amadora": (38.7538, -9.2308),
    "oeiras": (38.6979, -9.3017),
    "loures": (38.8309, -9.1685),
    "mafra": (38.9379, -9.3276),
    "braga": (41.5454, -8.4265),
    "coimbra": (40.2033, -8.4103),
    "aveiro": (40.6405, -8.6538),
    "leiria": (39.7436, -8.8071),
    "santarem": (39.2369, -8.6850),
    "evora": (38.5714, -7.9135),
    "faro": (37.0194, -7.9304),
}


def centroids(spark: SparkSession) -> DataFrame:
    rows = [(k, lat, lon) for k, (lat, lon) in CENTROIDS.items()]
    return spark.createDataFrame(rows, "locality string, latitude double, longitude double")


def geocode_join(df: DataFrame, places: DataFrame, origin: str, listing: str, mode: str, radius: str) -> DataFrame:
    """Add distance status, km, within_radius, reason and label of a listing from a search origin.

    ``places``: locality, latitude, longitude; null coordinates are a known miss. Unknown
    distances keep their reason and never exclude a listing.
    """
    known = places.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    df = df.withColumns({"origin_key": locality_key(F.col(origin)), "listing_key": locality_key(F.col(listing))})
    o = known.select(F.col("locality").alias("origin_key"), F.col("latitude").alias("_olat"), F.col("longitude").alias("_olon"))
    l = known.select(F.col("locality").alias("listing_key"), F.col("latitude").alias("_llat"), F.col("longitude").alias("_llon"))
    df = df.join(o, "origin_key", "left").join(l, "listing_key", "left")
    km = approximate_km(F.col("_olat"), F.col("_olon"), F.col("_llat"), F.col("_llon"))
    nationwide = F.col(mode) == "nationwide"
    reason = (
        F.when(nationwide, F.lit(None).cast("string"))
        .when(F.col("listing_key").isNull(), F.lit("missing_listing_locality"))
        .when(F.col("origin_key").isNull() | F.col("_olat").isNull(), F.lit("origin_not_found"))
        .when(F.col("_llat").isNull(), F.lit("listing_not_found"))
        .when(km.isNull(), F.lit("provider_error"))
    )
    df = df.withColumns({"distance_reason": reason, "_km": km})
    near = ~nationwide & F.col("distance_reason").isNull()
    return df.withColumns(
        {
            "distance_status": F.when(nationwide, F.lit("not_applicable"))
            .when(F.col("distance_reason").isNotNull(), F.lit("unknown"))
            .otherwise(F.lit("approximate")),
            "distance_km": F.when(near, F.col("_km")),
            "within_radius": F.when(near, F.col("_km") <= F.col(radius)),
            "distance_label": F.when(nationwide, F.lit("Nationwide search · distance not used"))
            .when(F.col("distance_reason").isNotNull(), F.lit("Distance unknown"))
            .otherwise(distance_label(F.col("_km"))),
        }
    ).drop("_olat", "_olon", "_llat", "_llon", "_km")
