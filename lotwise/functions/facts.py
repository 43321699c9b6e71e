"""Vehicle facts out of free text: years, distances, power, make and model, indicators.

``sources`` is an array of texts in order of trust (title, description, card facts). The
first text that yields a valid value wins. Every extractor is one native expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.functions.numbers import round_half_up
from lotwise.functions.text import AFTER_WORD, BEFORE_WORD, normalize_ws, words

# Limits of years, distances and power.
FIRST_YEAR, LAST_YEAR = 1950, 2100
MOST_KILOMETRES = 3_000_000
LEAST_HP, MOST_HP = 20, 2000

# Ordered make patterns; the first rule that matches anywhere wins.
MAKE_RULES = [
    ("mercedes(?:[ -]benz)?", "Mercedes-Benz"),
    ("land rover", "Land Rover"),
    ("alfa romeo", "Alfa Romeo"),
    ("volkswagen|vw", "Volkswagen"),
    ("bmw", "BMW"),
    ("audi", "Audi"),
    ("peugeot", "Peugeot"),
    ("renault", "Renault"),
    ("citro[eë]n", "Citroën"),
    ("seat", "SEAT"),
    ("[sš]koda", "Škoda"),
    ("toyota", "Toyota"),
    ("mazda", "Mazda"),
    ("mitsubishi", "Mitsubishi"),
    ("suzuki", "Suzuki"),
    ("ford", "Ford"),
    ("opel", "Opel"),
    ("fiat", "Fiat"),
    ("volvo", "Volvo"),
    ("nissan", "Nissan"),
    ("honda", "Honda"),
    ("hyundai", "Hyundai"),
    ("kia", "Kia"),
    ("dacia", "Dacia"),
    ("mini", "MINI"),
    ("tesla", "Tesla"),
]

# Ordered fuel patterns.
FUEL_RULES = [
    ("plug_in_hybrid", "plug[ -]?in|phev|h[ií]brido plug[ -]?in"),
    ("hybrid", "h[ií]brido|hybrid|hev"),
    ("electric", "el[eé]trico|electric|bev"),
    ("lpg", "gpl|lpg"),
    ("diesel", "diesel|gas[oó]leo|gasoil|tdi|dci|hdi|cdti|[0-9]{3}d"),
    ("petrol", "gasolina|petrol|gasoline|tsi|tfsi"),
]

# Ordered gearbox patterns.
GEARBOX_RULES = [
    ("automatic", "autom[aá]tic[oa]|automatic|dsg|cvt|tiptronic"),
    ("manual", "manual"),
]

# Warning indicators.
INDICATOR_RULES = {
    "financing": words("financiamento|financing|finance available|cr[eé]dito autom[oó]vel"),
    "monthly_payment": words("mensalidade|monthly|por m[eê]s|per month")
    + f"|(?iu){BEFORE_WORD}[0-9][0-9., ]*\\s*€\\s*/\\s*m[eê]s{AFTER_WORD}",
    "deposit": words("entrada|sinal|deposit|down payment"),
    "damaged": words(
        "acidentad[oa]|sinistrad[oa]|batid[oa]|danificad[oa]|damaged|accident damage|para pe[cç]as|for parts"
    ),
    "imported": words("importad[oa]|imported|matr[ií]cula estrangeira|foreign registration"),
}

SELLER_WORDS = words("particular|private seller|profissional|dealer|stand")

# Signs of contact data.
EMAIL = r"(?iu)(?<![A-Za-z0-9_])[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]{2,}(?![A-Za-z0-9_])"
PHONE = r"(?:\+?[0-9][\s().-]*){9,}"
CONTACT_LINK = r"(?iu)(?:wa\.me|whatsapp|facebook\.com/(?:profile|people|user)|mailto:|tel:)"
WEB_LINK = r"(?iu)https?://"

FUELS = ["petrol", "diesel", "hybrid", "plug_in_hybrid", "electric", "lpg", "other"]
GEARBOXES = ["manual", "automatic"]
SELLERS = ["private", "dealer"]
INDICATORS = list(INDICATOR_RULES)


def sources_of(title: Column, description: Column, card_facts: Column) -> Column:
    """Non-blank texts in order of trust."""
    listed = F.concat(F.array(title, description), F.coalesce(card_facts, F.array().cast("array<string>")))
    return F.filter(listed, lambda s: s.isNotNull() & (F.trim(s) != ""))


def joined_sources(sources: Column) -> Column:
    return F.array_join(sources, " · ")


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def first_hit(sources: Column, extract, value_type: str) -> Column:
    """First source for which ``extract`` finds a value, as struct(value, evidence)."""
    hits = F.transform(
        sources, lambda s: F.struct(extract(s).cast(value_type).alias("value"), s.alias("evidence"))
    )
    return _first(F.filter(hits, lambda h: h["value"].isNotNull()))


def year_in(text: Column, reference_year: Column) -> Column:
    years = F.regexp_extract_all(text, F.lit(f"{BEFORE_WORD}((?:19|20)[0-9]{{2}}){AFTER_WORD}"), F.lit(1))
    return _first(
        F.filter(
            F.transform(years, lambda y: y.cast("int")),
            lambda y: (y >= FIRST_YEAR) & (y <= reference_year + 1),
        )
    )


def find_year(sources: Column, reference_year: Column) -> Column:
    return first_hit(sources, lambda s: year_in(s, reference_year), "int")


# A year label directly in front ("Ano: 2015 km ...") keeps the number from being a distance.
_YEAR_LABEL = (
    r"(?:(?<![A-Za-z0-9_])(?:ano|year|année|año|baujahr|jahr)\s*[:\-]?\s*)?"
)
_AMOUNT = r"(?:[0-9]{1,3}(?:[ .][0-9]{3})+|[0-9]+(?:[.,][0-9]+)?\s*(?:k|mil)?)"
_DISTANCE_UNIT = r"(?:km|kms|quil[oó]metros?|mi|miles?)"
DISTANCE = f"(?iu)({_YEAR_LABEL})(?<![A-Za-z0-9_])({_AMOUNT})\\s*({_DISTANCE_UNIT}){AFTER_WORD}"


def magnitude(amount: Column) -> Column:
    """Numeric value of "123.456", "12,5k" or "80 mil"."""
    compact = F.regexp_replace(F.lower(amount), r"\s+", "")
    thousands = compact.rlike("(?:k|mil)$")
    number = F.regexp_replace(compact, "(?:k|mil)$", "")
    plain = F.regexp_replace(number, "[ ,.]", "").try_cast("double")
    scaled = F.regexp_replace(number, ",", ".").try_cast("double") * 1000
    return F.when(thousands, scaled).otherwise(plain)


def distance_in(text: Column) -> Column:
    hits = F.regexp_extract_all(text, F.lit(DISTANCE), F.lit(0))
    unlabelled = F.filter(hits, lambda h: ~h.rlike(r"(?iu)^(?:ano|year|année|año|baujahr|jahr)"))

    def kilometres(hit: Column) -> Column:
        amount = magnitude(F.regexp_extract(hit, DISTANCE, 2))
        miles = F.regexp_extract(hit, DISTANCE, 3).rlike("(?i)^(?:mi|miles?)$")
        return round_half_up(F.when(miles, amount * 1.609344).otherwise(amount))

    return _first(F.filter(F.transform(unlabelled, kilometres), lambda v: (v >= 0) & (v <= MOST_KILOMETRES)))


def find_mileage(sources: Column) -> Column:
    return first_hit(sources, distance_in, "bigint")


POWER = f"(?iu){BEFORE_WORD}([0-9]{{2,4}})\\s*(cv|hp|bhp|kw){AFTER_WORD}"


def power_in(text: Column) -> Column:
    """Horsepower of the first power text only; later ones are not tried."""
    amount = F.regexp_extract(text, POWER, 1).try_cast("double")
    kilowatts = F.lower(F.regexp_extract(text, POWER, 2)) == "kw"
    value = F.when(kilowatts, round_half_up(amount * 1.34102)).otherwise(amount)
    return F.when((value >= LEAST_HP) & (value <= MOST_HP), value)


def find_power(sources: Column) -> Column:
    return first_hit(sources, power_in, "int")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_pattern(text: Column, rules: list[tuple[str, str]]) -> Column:
    """First rule, in rule order, that matches: struct(value, evidence)."""

    def choose(t: Column) -> Column:
        choice = F.lit(None).cast("struct<value:string,evidence:string>")
        for value, pattern in reversed(rules):
            regex = words(pattern)
            hit = F.struct(F.lit(value).alias("value"), F.regexp_substr(t, F.lit(regex)).alias("evidence"))
            choice = F.when(t.rlike(regex), hit).otherwise(choice)
        return choice

    return let(text, choose)


_SKIPPED_TOKEN = (
    "(?iu)^(?:(?:19|20)[0-9]{2}|manual|autom[aá]tic[oa]|diesel|gas[oó]leo|gasolina|petrol|hybrid|h[ií]brido"
    "|electric|el[eé]trico)$"
)


def make_model_variant(title: Column) -> Column:
    """struct(make, model, variant) of a title."""

    def first_make(text: Column) -> Column:
        choice = F.lit(None).cast("struct<make:string,rest:string>")
        for pattern, name in reversed(MAKE_RULES):
            regex = words(pattern)
            rest = F.regexp_extract(text, f"(?s){regex}(.*)$", 1)
            hit = F.struct(F.lit(name).alias("make"), rest.alias("rest"))
            choice = F.when(text.rlike(regex), hit).otherwise(choice)
        return choice

    def with_parts(found: Column) -> Column:
        parts = F.filter(F.split(F.trim(found["rest"]), r"\s+"), lambda t: t != "")
        return F.struct(found["make"].alias("make"), parts.alias("parts"))

    def name_parts(found: Column) -> Column:
        make, parts = found["make"], found["parts"]
        head, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        # "Tesla Model 3": the model name takes two words.
        two_words = F.coalesce(
            (make == "Tesla") & (F.lower(head) == "model") & second.rlike("(?i)^(?:3|s|x|y)$"), F.lit(False)
        )
        cleaned = F.regexp_replace(head, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}-]+$", "")
        model = F.when(two_words, F.concat(F.lit("Model "), second)).when(cleaned != "", cleaned)
        kept = F.filter(
            parts,
            lambda t, i: (i >= F.when(two_words, F.lit(2)).otherwise(F.lit(1))) & ~t.rlike(_SKIPPED_TOKEN),
        )
        variant = F.when(F.size(kept) > 0, F.array_join(kept, " "))
        return F.struct(make.alias("make"), model.alias("model"), variant.alias("variant"))

    text = F.trim(F.regexp_replace(title, r"^\s*(?:19|20)[0-9]{2}\s+", ""))
    return let(let(let(text, first_make), with_parts), name_parts)


def indicator_sources(sources: Column, name: str) -> Column:
    """Texts that carry an indicator; the indicator is true when there is one."""
    return F.filter(sources, lambda s: s.rlike(INDICATOR_RULES[name]))


def seller_type(given: Column, text: Column) -> Column:
    inferred = F.when(text.rlike(words("profissional|dealer|stand")), F.lit("dealer")).when(
        text.rlike(words("particular|private seller")), F.lit("private")
    )
    return F.coalesce(given, inferred)


def contains_contact_data(text: Column, with_links: bool = False) -> Column:
    found = text.rlike(EMAIL) | text.rlike(PHONE) | text.rlike(CONTACT_LINK)
    return found | text.rlike(WEB_LINK) if with_links else found


def any_contact_data(texts: Column) -> Column:
    return F.exists(texts, lambda t: F.coalesce(contains_contact_data(t), F.lit(False)))


def clean_allowlisted(text: Column, maximum: int) -> Column:
    """Collapsed text, or null when it is empty, too long, or carries private wording."""

    def allowed(value: Column) -> Column:
        private = value.rlike(
            r"(?iu)https?://|www\.|contact|perfil|profile|telefone|telem[oó]vel|pagamento|payment|iban"
            r"|financiamento|prestaç|mensalidade|entrada|sinal|login|captcha"
        )
        clean = ~contains_contact_data(value) & ~private
        return F.when((value != "") & (F.length(value) <= maximum) & clean, value)

    return let(normalize_ws(text), allowed)


def explicit_indicator(text: Column, positive: str) -> Column:
    """No/yes wording to a flag; null when the text says neither."""
    return (
        F.when(text.rlike(r"(?iu)^(?:n[aã]o|no|sem|without|nacional)(?![A-Za-z0-9_])"), F.lit(False))
        .when(text.rlike(r"(?iu)^(?:sim|yes)$") | text.rlike(f"(?iu){positive}"), F.lit(True))
    )


def structured_year(value: Column) -> Column:
    whole = value == F.floor(value)
    return F.when(whole & (value >= FIRST_YEAR) & (value <= LAST_YEAR), value.cast("int"))


def structured_odometer(value: Column, unit: Column) -> Column:
    km = round_half_up(F.when(F.contains(F.lower(unit), F.lit("mile")), value * 1.609344).otherwise(value))
    return F.when((value >= 0) & unit.isNotNull() & (km <= MOST_KILOMETRES), km.cast("bigint"))


def structured_fuel(text: Column) -> Column:
    t = F.lower(text)
    return F.when(
        F.trim(text) != "",
        F.when(t.rlike("diesel|gas[oó]leo|gasoil"), F.lit("diesel"))
        .when(t.rlike("petrol|gasoline|gasolina"), F.lit("petrol"))
        .when(t.rlike("plug.?in|phev"), F.lit("plug_in_hybrid"))
        .when(t.rlike("hybrid|h[ií]brido|hev"), F.lit("hybrid"))
        .when(t.rlike("electric|el[eé]trico|bev"), F.lit("electric"))
        .when(t.rlike("lpg|gpl"), F.lit("lpg"))
        .otherwise(F.lit("other")),
    )


def structured_gearbox(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike("automatic|autom[aá]tic|dsg|cvt|tiptronic"), F.lit("automatic")).when(
        t.rlike("manual"), F.lit("manual")
    )


def structured_power(value: Column) -> Column:
    whole = value == F.floor(value)
    return F.when(whole & (value >= LEAST_HP) & (value <= MOST_HP), value.cast("int"))


def clean_structured(text: Column) -> Column:
    value = normalize_ws(text)
    return F.when(value != "", value)


def split_model_display(model: Column, trim: Column) -> Column:
    """struct(model, variant): first word of the display name, then the rest with the trim."""
    name, extra = clean_structured(model), clean_structured(trim)
    parts = F.split(name, r"\s+")
    rest = F.array_compact(
        F.concat(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(extra))
    )
    variant = F.when(name.isNull(), extra).otherwise(F.when(F.size(rest) > 0, F.array_join(rest, " ")))
    return F.struct(F.try_element_at(parts, F.lit(1)).alias("model"), variant.alias("variant"))
