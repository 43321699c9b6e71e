import pytest
from pyspark.sql import functions as F

from lotwise.operators.classify import classify_titles
from lotwise.operators.matching import criteria_map, criterion, evaluate_criteria
from lotwise.operators.quality import redact_columns
from lotwise.plans.normalize import normalize_facts


@pytest.mark.parametrize(
    "title, subject, patterns",
    [
        ("Hot Wheels Porsche 1/43", "collectible", ["hot wheels", "1/43"]),
        ("Volkswagen Golf só para peças", "whole_vehicle", ["só para peças"]),
        ("CAPO / PARA CHOQUE Peugeot", "part_or_accessory", ["capô", "para-choque"]),
        ("Módulos de Bateria – Volkswagen Golf GTE 2019", "part_or_accessory", ["bateria", "módulos"]),
        ("Catálogo Renault Clio", "printed_material", ["catálogo"]),
        ("Motorizada Yamaha", "unknown", []),
    ],
)
def test_titles(spark, title, subject, patterns):
    row = classify_titles(spark.createDataFrame([(title,)], "title string")).first()
    assert row["subject"] == subject
    assert [m["pattern"] for m in row["matched_patterns"]] == patterns
    assert row["decision"] == ("exclude" if patterns else "continue")


FACTS = (
    "title string, description string, card_facts array<string>, make string, model string, variant string, price_cents bigint, "
    "year int, mileage bigint, fuel string, gearbox string, power_hp int, seller_type string"
)


def match(spark, criteria, **facts):
    row = dict(title="Golf", description=None, card_facts=[], make="Volkswagen", model="Golf", variant=None, price_cents=None, year=None,
               mileage=None, fuel=None, gearbox=None, power_hp=None, seller_type=None)
    row.update(facts)
    df = spark.createDataFrame([tuple(row.values())], FACTS).withColumn("criteria", criteria)
    return evaluate_criteria(df).first()["match_status"]


def test_unknown_facts_need_information(spark):
    price = criteria_map(price_range=criterion("hard", maximum=F.lit(10_000)))
    assert match(spark, price) == "needs_information"
    assert match(spark, price, price_cents=1_000_000) == "matches"
    assert match(spark, price, price_cents=1_000_001) == "excluded"


def test_required_words_wait_for_a_description(spark):
    words = criteria_map(required_keywords=criterion("hard", F.array(F.lit("Híbrido"))))
    assert match(spark, words) == "needs_information"
    assert match(spark, words, description="nada") == "excluded"
    assert match(spark, words, description="motor HIBRIDO") == "matches"


def test_model_prefix_stays_open(spark):
    target = criteria_map(model_target=criterion("hard", F.array(F.lit("VW"), F.lit("Golf Plus"))))
    assert match(spark, target) == "needs_information"
    assert match(spark, target, variant="Plus TDI") == "matches"
    assert match(spark, target, variant="GTI") == "excluded"
    assert match(spark, target, make="Audi") == "excluded"


def test_structured_values_beat_text(spark):
    df = spark.createDataFrame(
        [("BMW 320d 2015", "100 000 km importado", "20.000 €", ["190 cv"])], "title string, description string, displayed_price string, card_facts array<string>"
    ).withColumn(
        "structured",
        F.expr(
            "named_struct('make', cast(null as string), 'model', cast(null as string), 'variant', cast(null as string), 'year', 2016, 'mileage', 90000L,"
            " 'fuel', cast(null as string), 'gearbox', cast(null as string), 'power_hp', cast(null as int), 'seller_type', 'dealer', 'imported', false)"
        ),
    )
    row = normalize_facts(df, F.lit(2026), "structured").first()
    assert (row["year"], row["mileage"], row["fuel"], row["power_hp"], row["price_cents"]) == (2016, 90_000, "diesel", 190, 2_000_000)
    assert (row["imported"], row["seller_type"], row["make"]) == (False, "dealer", "BMW")
    assert row["evidence"]["year"] == ["Source structured: 2016"]


def test_known_secrets_are_blanked(spark):
    df = spark.createDataFrame([("id s3cr3t here", {"api-key": "x", "note": "s3cr3t"})], "text string, options map<string,string>")
    row = redact_columns(df, F.array(F.lit("s3cr3t"))).first()
    assert row["text"] == "id [redacted] here"
    assert row["options"] == {"api-key": "[redacted]", "note": "[redacted]"}
