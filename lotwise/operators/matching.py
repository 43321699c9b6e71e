"""Saved-search criteria against listing facts, in three-valued logic.

A search carries ``criteria``: map of criterion name to struct(strength, words, minimum, maximum).
Unknown facts give NULL, so a hard criterion can fail, hold or need information.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.numbers import round_half_up
from lotwise.functions.text import fold, identity_key, make_key

CRITERIA = [
    "model_target",
    "make_keywords",
    "model_keywords",
    "variant_keywords",
    "price_range",
    "minimum_year",
    "maximum_mileage",
    "fuels",
    "gearboxes",
    "minimum_power",
    "seller",
    "required_keywords",
    "excluded_keywords",
]

CRITERION_TYPE = "struct<strength:string,words:array<string>,minimum:bigint,maximum:bigint>"


def criterion(strength: str | Column, words: Column | None = None, minimum=None, maximum=None) -> Column:
    """Build one criterion value."""
    strength = F.lit(strength) if isinstance(strength, str) else strength
    return F.struct(
        strength.alias("strength"),
        (words if words is not None else F.lit(None)).cast("array<string>").alias("words"),
        (minimum if minimum is not None else F.lit(None)).cast("bigint").alias("minimum"),
        (maximum if maximum is not None else F.lit(None)).cast("bigint").alias("maximum"),
    )


def criteria_map(**criteria: Column) -> Column:
    """Map of the criteria that are present; null ones are left out."""
    entries = F.array(
        *[F.struct(F.lit(name).alias("key"), value.alias("value")) for name, value in criteria.items()]
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def keyword_any(value: Column, keywords: Column) -> Column:
    return F.when(value.isNotNull(), F.exists(keywords, lambda k: F.contains(fold(value), fold(k))))


def model_matches(model: Column, variant: Column, target: Column) -> Column:
    """Equality of model names; a known prefix of a longer name stays unknown without a variant."""
    known, expected = _words(model), _words(target)
    prefix = (known != "") & expected.startswith(F.concat(known, F.lit(" ")))
    combined = _words(F.concat_ws(" ", model, variant))
    longer = (combined == expected) | combined.startswith(F.concat(expected, F.lit(" ")))
    return F.when(
        model.isNotNull(),
        F.when(identity_key(model) == identity_key(target), F.lit(True))
        .when(prefix, F.when(variant.isNotNull(), longer))
        .otherwise(F.lit(False)),
    )


def _explain(label: str, value: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit(f"{label} normalized as "), value.cast("string")), F.lit(f"{label} is unknown")
    )


def listing_text(title: Column, description: Column, card_facts: Column) -> Column:
    return fold(F.concat_ws(" ", title, description, F.array_join(card_facts, " ")))


def evaluate_criteria(df: DataFrame, criteria: str = "criteria") -> DataFrame:
    """Add match_status, hard_failures, missing_criteria and soft_contributions.

    ``df`` is listings joined to their searches: facts make, model, variant, price_cents, year,
    mileage, fuel, gearbox, power_hp, seller_type, title, description, card_facts.
    """
    c = {name: F.try_element_at(F.col(criteria), F.lit(name)) for name in CRITERIA}
    df = df.withColumn(
        "_text", listing_text(F.col("title"), F.col("description"), F.col("card_facts"))
    )
    target = [F.get(c["model_target"]["words"], F.lit(i)) for i in range(3)]
    model_target = (
        (make_key(F.col("make")) == make_key(target[0]))
        & model_matches(F.col("model"), F.col("variant"), target[1])
        & F.when(target[2].isNull(), F.lit(True)).otherwise(keyword_any(F.col("variant"), F.array(target[2])))
    )
    named = F.concat_ws(" ", F.when(F.col("model") != "", F.col("model")), F.when(F.col("variant") != "", F.col("variant")))
    named = F.when(named != "", named)
    price = c["price_range"]
    in_range = (price["minimum"].isNull() | (F.col("price_cents") >= price["minimum"] * 100)) & (
        price["maximum"].isNull() | (F.col("price_cents") <= price["maximum"] * 100)
    )
    all_present = F.forall(c["required_keywords"]["words"], lambda k: F.contains(F.col("_text"), fold(k)))
    none_present = F.forall(c["excluded_keywords"]["words"], lambda k: ~F.contains(F.col("_text"), fold(k)))
    rules = {
        "model_target": (
            model_target,
            F.concat(
                F.lit("Model target: "),
                F.concat_ws(" ", target[0], target[1], F.when(target[2] != "", target[2])),
            ),
        ),
        "make_keywords": (keyword_any(F.col("make"), c["make_keywords"]["words"]), _explain("make", F.col("make"))),
        "model_keywords": (keyword_any(named, c["model_keywords"]["words"]), _explain("model", F.col("model"))),
        "variant_keywords": (
            keyword_any(F.col("variant"), c["variant_keywords"]["words"]),
            _explain("variant", F.col("variant")),
        ),
        "price_range": (
            F.when(F.col("price_cents").isNotNull(), in_range),
            _explain("price", F.col("price_cents")),
        ),
        "minimum_year": (F.col("year") >= c["minimum_year"]["minimum"], _explain("year", F.col("year"))),
        "maximum_mileage": (
            F.col("mileage") <= c["maximum_mileage"]["maximum"],
            _explain("mileage", F.col("mileage")),
        ),
        "fuels": (F.array_contains(c["fuels"]["words"], F.col("fuel")), _explain("fuel", F.col("fuel"))),
        "gearboxes": (
            F.array_contains(c["gearboxes"]["words"], F.col("gearbox")),
            _explain("transmission", F.col("gearbox")),
        ),
        "minimum_power": (F.col("power_hp") >= c["minimum_power"]["minimum"], _explain("power", F.col("power_hp"))),
        "seller": (
            F.array_contains(c["seller"]["words"], F.col("seller_type")),
            _explain("seller type", F.col("seller_type")),
        ),
        "required_keywords": (
            F.when(all_present, F.lit(True)).when(F.col("description").isNotNull(), F.lit(False)),
            F.lit("required keyword check against original listing text"),
        ),
        "excluded_keywords": (none_present, F.lit("excluded keyword check against original listing text")),
    }
    items = F.array_compact(
        F.array(
            *[
                F.when(
                    c[name].isNotNull(),
                    F.struct(
                        F.lit(name).alias("criterion"),
                        c[name]["strength"].alias("strength"),
                        matched.alias("matched"),
                        explanation.alias("explanation"),
                    ),
                )
                for name, (matched, explanation) in rules.items()
            ]
        )
    )
    df = df.withColumn("_items", items)
    hard = F.filter("_items", lambda i: i["strength"] == "hard")
    df = df.withColumns(
        {
            "hard_failures": F.filter(hard, lambda i: i["matched"].eqNullSafe(F.lit(False))),
            "missing_criteria": F.filter(hard, lambda i: i["matched"].isNull()),
            "soft_contributions": F.filter("_items", lambda i: i["strength"] == "soft"),
        }
    )
    status = (
        F.when(F.size("hard_failures") > 0, F.lit("excluded"))
        .when(F.size("missing_criteria") > 0, F.lit("needs_information"))
        .otherwise(F.lit("matches"))
    )
    return df.withColumn("match_status", status).drop("_items", "_text")


def personal_fit(df: DataFrame, soft: str = "soft_contributions") -> DataFrame:
    """Add counts, percentage and status of the soft criteria."""
    matched = F.size(F.filter(soft, lambda i: i["matched"].eqNullSafe(F.lit(True))))
    missed = F.size(F.filter(soft, lambda i: i["matched"].eqNullSafe(F.lit(False))))
    df = df.withColumns({"fit_matched": matched, "fit_missed": missed})
    total, known = F.size(soft), F.col("fit_matched") + F.col("fit_missed")
    unknown = total - known
    status = (
        F.when(total == 0, F.lit("no_preferences"))
        .when(known == 0, F.lit("needs_information"))
        .when(unknown > 0, F.lit("partial"))
        .otherwise(F.lit("assessed"))
    )
    text = F.when(total == 0, F.lit("The search names no wishes.")).otherwise(
        F.concat(
            F.col("fit_matched").cast("string"),
            F.lit(" met, "),
            F.col("fit_missed").cast("string"),
            F.lit(" not met, "),
            unknown.cast("string"),
            F.lit(" open. Only wishes that can be judged count; distance does not."),
        )
    )
    return df.withColumns(
        {
            "fit_unknown": unknown,
            "fit_status": status,
            "fit_percent": F.when(known > 0, round_half_up(F.col("fit_matched") / known * 100).cast("int")),
            "fit_explanation": text,
        }
    )


def best_match_status(matches: DataFrame, key: str = "listing_id", status: str = "match_status") -> DataFrame:
    """Best status over the searches of a listing: matches, then needs_information, then excluded."""
    level = F.max(
        F.when(F.col(status) == "matches", 2).when(F.col(status) == "needs_information", 1).otherwise(0)
    )
    return matches.groupBy(key).agg(level.alias("_level")).select(
        key,
        F.when(F.col("_level") == 2, F.lit("matches"))
        .when(F.col("_level") == 1, F.lit("needs_information"))
        .otherwise(F.lit("excluded"))
        .alias("best_status"),
    )


def plausible_listings(matches: DataFrame, key: str = "listing_id") -> DataFrame:
    """Listings with at least one search that does not exclude them."""
    return matches.filter(F.col("match_status") != "excluded").select(key).distinct()


# Searches that may be broadcast; a map of criteria takes about 700 bytes, whatever it has on disk.
MOST_BROADCAST = 100_000


def fan_out(listings: DataFrame, links: DataFrame, searches: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Listing × its searches over the link table.

    More than ``most`` searches meet the links by search, before these meet the listings: so neither the driver holds
    all criteria nor are the texts of a listing shuffled for each of its links.
    """
    links = links.select("listing_id", "search_id").hint("merge")
    if searches.count() <= most:
        return listings.join(links, "listing_id").join(searches, "search_id")
    return listings.join(links.join(searches.hint("merge"), "search_id").hint("merge"), "listing_id")
