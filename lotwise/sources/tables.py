"""Reading tables and merging results into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder; times without a zone are taken as UTC."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df


def scan_table(df: DataFrame, columns: list[str], order: list[str], where: Column | None = None) -> DataFrame:
    """Columns of a table in key order; ``where`` makes it a lookup."""
    kept = df if where is None else df.filter(where)
    return kept.select(*columns).orderBy(*order)


def append_once(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose key is new, one per key; append these."""
    return incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def upsert_minmax(existing: DataFrame, incoming: DataFrame, key: list[str], latest: list[str]) -> DataFrame:
    """Merge sightings: earliest first_seen_at, latest last_seen_at, other columns of the latest."""
    both = existing.unionByName(incoming)
    row = F.max(F.struct("last_seen_at", *latest))
    return both.groupBy(*key).agg(
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), row.alias("_r")
    ).select(*key, "first_seen_at", "last_seen_at", *[F.col(f"_r.{c}").alias(c) for c in latest])


def upsert_latest(existing: DataFrame, incoming: DataFrame, key: list[str], version: str) -> DataFrame:
    """Last write wins per key; an incoming row replaces a stored one of the same version."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c not in key]
    row = F.max(F.struct(F.col(version).alias("_version"), "_new", *[F.col(c).alias(f"v_{c}") for c in rest]))
    return both.groupBy(*key).agg(row.alias("_r")).select(*key, *[F.col(f"_r.v_{c}").alias(c) for c in rest])


def replace_groups(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Whole new set of groups; a group that was there before keeps its creation time."""
    kept = old.select("group_id", F.col("created_at").alias("_created"))
    return new.join(kept, "group_id", "left").withColumns(
        {"created_at": F.coalesce("_created", now), "updated_at": now}
    ).drop("_created")


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not deleted; apply to each derived table of a deleted parent."""
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def retention_due(df: DataFrame, expires_at: Column, now: Column) -> DataFrame:
    return df.filter(expires_at.isNotNull() & (expires_at <= now))


def needs_version(df: DataFrame, stored: DataFrame, key: str, version: int) -> DataFrame:
    """Rows without a stored result of this version."""
    done = stored.filter(F.col("version") == version).select(key)
    return df.join(done, key, "left_anti")

