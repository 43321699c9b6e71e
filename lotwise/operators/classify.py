"""Keyword classification of titles and risk flags of facts."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.text import match_text

CLASSIFIER_VERSION = 2

# Ordered patterns by category.
PATTERNS = {
    "collectible": [
        "hot wheel", "hot wheels", "hotwheels", "miniatura", "die-cast", "1/18", "1/43", "maquete", "brinquedo",
    ],
    "part": [
        "peça", "peças", "jante", "jantes", "pneu", "pneus", "rodas de ferro", "espaçador",
        "espaçadores", "volante", "volantes", "banco", "bancos", "palas", "tablier", "rádio",
        "quadrante", "painel", "chave secundária", "chave de rodas", "capa de volante", "macaco",
        "alargador", "alargadores", "calha da água",
    ],
    "body_or_light": [
        "farol", "farolim", "faróis", "capô", "para-choque", "guarda-lamas", "grelha",
        "retrovisor", "espelho", "chuventos", "tecto de abrir", "teto de abrir", "aileron", "spoiler",
    ],
    "mechanical_or_electrical": [
        "bateria", "módulo", "módulos", "motor", "centralina", "medidor de massa de ar",
        "barra estabilizadora", "sofagem", "fita de airbag",
    ],
    "printed_material": ["catálogo", "apresentação"],
}
# Fixed value: wording of a vehicle that is sold for its parts.
PARTS_ONLY = "só para peças"


def plain_pattern(pattern: str) -> str:
    """The pattern in the form :func:`match_text` gives to titles."""
    text = unicodedata.normalize("NFKD", pattern)
    text = "".join(c for c in text if not unicodedata.category(c).startswith("M")).lower()
    return re.sub(r"\s+", " ", re.sub("[‐‑‒–—―-]+", " ", text)).strip()


def whole_term(pattern: str) -> str:
    return f"(?:^|[^a-z0-9]){plain_pattern(pattern)}(?=$|[^a-z0-9])"


def default_rules() -> list[tuple[str, str]]:
    return [("parts_only", PARTS_ONLY)] + [(c, p) for c, ps in PATTERNS.items() for p in ps]


def classify_titles(df: DataFrame, title: str = "title") -> DataFrame:
    """Add matched_patterns, subject, condition and decision of a title."""
    rules = default_rules()
    any_term = "|".join(whole_term(p) for _, p in rules)
    text = F.col("_match_text")
    parts_only = text.rlike(whole_term(PARTS_ONLY))
    hits = []
    for category, pattern in rules:
        hit = text.rlike(whole_term(pattern))
        if pattern == "peças":
            hit = hit & ~parts_only
        hits.append(F.when(hit, F.struct(F.lit(category).alias("category"), F.lit(pattern).alias("pattern"))))
    none = F.array().cast("array<struct<category:string,pattern:string>>")
    # One scan rules out the many titles without any term before each term is tried.
    matched = F.when(text.rlike(any_term), F.array_compact(F.array(*hits))).otherwise(none)
    df = df.withColumn("_match_text", match_text(F.col(title))).withColumn("matched_patterns", matched)
    return df.withColumns(
        {
            "classifier_version": F.lit(CLASSIFIER_VERSION),
            "subject": subject_of(F.col("matched_patterns")),
            "condition": F.when(_has(F.col("matched_patterns"), "parts_only"), F.lit("parts_only")).otherwise(F.lit("unknown")),
            "decision": F.when(F.size("matched_patterns") > 0, F.lit("exclude")).otherwise(F.lit("continue")),
        }
    ).drop("_match_text")


def _has(matched: Column, category: str) -> Column:
    return F.exists(matched, lambda m: m["category"] == category)


def subject_of(matched: Column) -> Column:
    return (
        F.when(_has(matched, "collectible"), F.lit("collectible"))
        .when(_has(matched, "printed_material"), F.lit("printed_material"))
        .when(_has(matched, "parts_only"), F.lit("whole_vehicle"))
        .when(F.size(matched) > 0, F.lit("part_or_accessory"))
        .otherwise(F.lit("unknown"))
    )


# Cents below which a price is suspicious, and the label of price flags.
LOW_PRICE_CENTS = 100_000
VERIFY_PRICE = "HIGH RISK / VERIFY PRICE"

# Flag codes with label and wording, in report order.
RISKS = [
    ("financing_price", VERIFY_PRICE, "Listing text mentions financing"),
    ("monthly_payment_price", VERIFY_PRICE, "Displayed amount may be a monthly payment"),
    ("deposit_price", VERIFY_PRICE, "Displayed amount may be a deposit or down payment"),
    ("suspiciously_low_price", VERIFY_PRICE, "Vehicle price is below EUR 1,000"),
    ("damaged_vehicle", "VERIFY CONDITION", "Listing text indicates damage or parts-only status"),
    ("imported_vehicle", "VERIFY IMPORT HISTORY", "Listing text indicates an imported vehicle"),
]


def risk_flags(df: DataFrame) -> DataFrame:
    """Add risk_reasons and high_risk from indicators and price."""
    price = F.col("price_cents")
    conditions = [
        F.col("financing"),
        F.col("monthly_payment"),
        F.col("deposit"),
        (price > 0) & (price < LOW_PRICE_CENTS),
        F.col("damaged"),
        F.col("imported"),
    ]
    reasons = F.array_compact(
        F.array(
            *[
                F.when(
                    cond,
                    F.struct(F.lit(code).alias("code"), F.lit(label).alias("label"), F.lit(text).alias("explanation")),
                )
                for cond, (code, label, text) in zip(conditions, RISKS)
            ]
        )
    )
    df = df.withColumn("risk_reasons", reasons)
    return df.withColumn("high_risk", F.exists("risk_reasons", lambda r: r["label"] == VERIFY_PRICE))
