"""Running values per key that do not put a whole key into one task.

A plain window sorts all rows of a key in one task. Here a key is cut into chunks (a day, a block
of positions, a measured number of rows): a window runs inside each chunk, each chunk is reduced to one carry value, and the
carries run over the few chunks of the key. Rows join their carry on (key, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.session import ensure_checkpoint_dir

# Rows of a measured chunk, which one task sorts.
CHUNK_ROWS = 1_000_000


def running(
    df: DataFrame,
    key: list[str],
    chunk: Column,
    order: list[str],
    values: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Add running ``sum``, ``max``, ``min`` or ``last`` (non-null) columns.

    ``chunk`` must not decrease along ``order``. With ``inclusive=False`` a row sees only the rows
    before it. ``order`` may hold sort expressions (descending, nulls last) unless ``last`` is asked for.
    """
    df = df.withColumn("_chunk", chunk)
    inside = (
        Window.partitionBy(*key, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    )
    within, totals = {}, []
    for name, (kind, value) in values.items():
        if kind == "last":
            within[f"_in_{name}"] = F.last(value, ignorenulls=True).over(inside)
            place = F.struct(*order)
            totals.append(F.max(F.when(value.isNotNull(), F.struct(place.alias("o"), value.alias("v"))))["v"].alias(f"_t_{name}"))
        else:
            aggregate = getattr(F, kind)
            within[f"_in_{name}"] = aggregate(value).over(inside)
            totals.append(aggregate(value).alias(f"_t_{name}"))
    chunks = df.groupBy(*key, "_chunk").agg(*totals)
    before = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carries = chunks.select(
        *key,
        "_chunk",
        *[
            (F.last(f"_t_{n}", ignorenulls=True) if kind == "last" else getattr(F, kind)(f"_t_{n}")).over(before).alias(f"_c_{n}")
            for n, (kind, _) in values.items()
        ],
    )
    joined = df.withColumns(within).join(carries, [*key, "_chunk"], "left")
    out = {}
    for name, (kind, _) in values.items():
        own, carried = F.col(f"_in_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            out[name] = F.coalesce(own, F.lit(0)) + F.coalesce(carried, F.lit(0))
        elif kind == "last":
            out[name] = F.coalesce(own, carried)
        else:
            out[name] = (F.greatest if kind == "max" else F.least)(own, carried)
    drop = ["_chunk", *within, *[f"_c_{n}" for n in values]]
    return joined.withColumns(out).drop(*drop)


def measured_chunks(df: DataFrame, key: list[str], order: list, rows: int = CHUNK_ROWS, name: str = "_part") -> DataFrame:
    """Add a chunk of at most ``rows`` rows that does not decrease along ``order`` inside a key.

    Rows are dealt out by ranges of key and order, sized by sampling whatever a key or a time holds,
    and each range is cut by position. ``order`` should tell rows of a key apart; equal rows are
    placed as they come. Written to the shared folder, so that chunks stay what they are when a task
    runs again.
    """
    ensure_checkpoint_dir(df.sparkSession)
    dealt = df.repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*key, *order))
    chunk = F.struct(F.col("_range").alias("range"), F.floor((place - 1) / F.lit(rows)).alias("piece"))
    return dealt.withColumn(name, chunk).drop("_range").checkpoint()


def day_of(at: str) -> Column:
    """Chunk by calendar day."""
    return F.to_date(F.col(at))


def block_of(position: str, size: int = 4096) -> Column:
    """Chunk by block of positions."""
    return F.floor(F.col(position) / F.lit(size))
