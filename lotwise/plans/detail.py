"""Nested detail view per listing, and texts for the seller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.text import plain_text


def nested(df: DataFrame, key: str, order: list[str], columns: list[str], name: str) -> DataFrame:
    """Rows of each key as a sorted list, the sort columns first."""
    item = F.struct(*order, *[c for c in columns if c not in order])
    return df.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(name))


def listing_detail(listings: DataFrame, wanted: DataFrame, parts: dict[str, tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """Documents of the ``wanted`` listings (a table of listing_id): one nested list per part.

    Parts are name to (rows, order, columns). Only the wanted listings are nested.
    """
    doc = listings.join(wanted, "listing_id", "left_semi")
    for name, (rows, order, columns) in parts.items():
        mine = rows.join(wanted, "listing_id", "left_semi")
        doc = doc.join(nested(mine, "listing_id", order, columns, name), "listing_id", "left")
    return doc


def seller_message(year: Column, make: Column, model: Column, variant: Column, title: Column) -> Column:
    named = F.concat_ws(" ", year.cast("string"), make, model, variant)
    vehicle = F.when(named != "", named).otherwise(plain_text(title))
    return F.concat(
        F.lit("Good day, I saw your "),
        vehicle,
        F.lit(
            " and would like to come and see it. Is it for sale at the price shown, "
            "and what should I know about its past and its state? Kind regards."
        ),
    )


def seller_questions(imported: Column, seller_type: Column) -> Column:
    return F.array_compact(
        F.array(
            F.lit("Can it still be bought, and is the price shown all there is to pay?"),
            F.lit("Which service and inspection papers come with it?"),
            F.when(imported, F.lit("When did it enter the country, and are its earlier papers at hand?")),
            F.lit("Has it been in a crash, had body work, or anything that needs repair now?"),
            F.lit("May I look it over and drive it before I decide?"),
            F.when(seller_type == "dealer", F.lit("Does the price cover a warranty, and which?")),
        )
    )
