import pytest
from pyspark.sql import functions as F

from lotwise.functions import facts as X
from lotwise.functions import numbers as N
from lotwise.functions import similarity as S
from lotwise.functions import text as T
from lotwise.functions import urls as U


def test_fold(one):
    assert one(T.fold(F.lit("Citroën ŠKODA São è̂ Ångström ß ø"))) == "citroen skoda sao e angstrom ß ø"


def test_keys(one):
    assert one(T.make_key(F.lit(" VW "))) == "volkswagen"
    assert one(T.model_target_key(F.lit("Citroën"), F.lit("C-3"), F.lit(None).cast("string"))) == "citroen:c3:"
    assert one(T.locality_key(F.lit(" Lisbon , Portugal"))) == "lisboa"
    assert one(T.slug(F.lit("  Série 3 / Gran Turismo "))) == "serie-3-gran-turismo"


def test_tokens(one):
    text = F.lit("O Carro BMW 320d de 2020, 190 cv de Lisboa e BMW")
    assert one(T.tokens(text)) == ["2020", "320d", "bmw", "cv", "lisboa"]


@pytest.mark.parametrize(
    "shown, cents",
    [
        ("€12.345,67", 1_234_567),
        ("12,345.67 €", 1_234_567),
        ("1.250 €", 125_000),
        ("1.25 €", 125),
        ("free", 0),
        ("Grátis", 0),
        ("12", None),
        ("€", None),
    ],
)
def test_prices(one, shown, cents):
    assert one(N.parse_eur_cents(F.lit(shown))) == cents


@pytest.mark.parametrize("value, rounded", [(-2.5, -2.0), (2.5, 3.0), (-2.51, -3.0)])
def test_round_half_up(one, value, rounded):
    assert one(N.round_half_up(F.lit(value))) == rounded


@pytest.mark.parametrize(
    "text, km",
    [("100 mi", 161), ("12.5 km", 125), ("Ano 2015 km", None), ("80 mil km", 80_000), ("12,5k km", 12_500), ("120.000 kms", 120_000)],
)
def test_distances_in_text(one, text, km):
    assert one(X.distance_in(F.lit(text))) == km


def test_power_looks_at_the_first_text_only(one):
    assert one(X.power_in(F.lit("5000 km 140 kW, 190 cv"))) == 188
    assert one(X.power_in(F.lit("10 cv and 190 cv"))) is None


@pytest.mark.parametrize(
    "title, expected",
    [
        ("2019 Tesla Model 3 Long Range", ("Tesla", "Model 3", "Long Range")),
        ("Škoda Octavia 2.0 TDI 2015 manual", ("Škoda", "Octavia", "2.0 TDI")),
        ("Peugeot", ("Peugeot", None, None)),
        ("Nothing here", (None, None, None)),
    ],
)
def test_make_model_variant(one, title, expected):
    assert tuple(one(X.make_model_variant(F.lit(title)))) == expected


def test_pattern_order_wins_over_position(one):
    assert one(X.first_pattern(F.lit("diesel hybrid"), X.FUEL_RULES))["value"] == "hybrid"


def test_contact_data(one):
    assert one(X.contains_contact_data(F.lit("write a.b@c.pt")))
    assert one(X.contains_contact_data(F.lit("call 912 345 678")))
    assert not one(X.contains_contact_data(F.lit("120 000 km, 2015")))


def test_hash_similarity(one):
    zero = F.lit("0" * 16)
    assert one(S.hash_similarity(F.lit("0" * 15 + "1"), zero)) == 0.984
    assert one(S.hash_similarity(F.lit("f" * 16), zero)) == 0.0


def test_difference_hash(one):
    falling = F.array(*[F.lit(9 - i % 9) for i in range(72)])
    assert one(S.dhash64(falling)) == "f" * 16
    assert one(S.dhash64(F.array(F.lit(1)))) is None


def test_canonical_url(one):
    build = "https://www.market.example/item/{id}/"
    found = lambda u: one(U.canonical_url(F.lit(u), r"^(?:www\.)?market\.example$", r"^/item/(\d+)(?:/|$)", build, "https://www.market.example"))
    assert tuple(found("/item/12/?ref=x")) == ("12", "https://www.market.example/item/12/")
    assert found("http://www.market.example/item/12/") is None
    assert found("https://user:pw@www.market.example/item/12/") is None
    assert found("https://www.market.example:8443/item/12/") is None


def test_unescape(one):
    assert one(T.unescape_string(F.lit('S\\u00e3o\\nX \\"q\\"'))) == 'São\nX "q"'
