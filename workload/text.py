"""Text functions over documents, conversations and listing texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions import facts as X
from lotwise.functions import text as T
from lotwise.functions.numbers import age_days, is_price_text, parse_eur_cents, round_half_up, vehicle_age
from lotwise.functions.similarity import hash_similarity, sign_hash64
from lotwise.operators.duplicates import (
    fingerprints,
    image_candidates,
    near_duplicate_texts,
)
from lotwise.plans.normalize import enrichment_fallback, enrichment_input, normalize_facts
from lotwise.plans.detail import seller_message, seller_questions
from workload import market as M
from workload import query

_FOLD = "strip_accents(lower({}))"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TOKENS = (
    "list_sort(list_distinct(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^a-z0-9]+'),"
    f" lambda x: length(x) >= 2 AND NOT list_contains([{_STOP}], x) AND NOT regexp_matches(x, '^[0-9]{{1,3}}$'))))"
)


@query(
    "fold_keys",
    """SELECT doc_id, sha256(strip_accents(lower(text))) AS folded,
      sha256(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]', '', 'g')) AS identity FROM documents""",
)
def fold_keys(t):
    """Folded text and identity key of every document, as digests."""
    return t.documents.select(
        "doc_id", F.sha2(T.fold(F.col("text")), 256).alias("folded"), F.sha2(T.identity_key(F.col("text")), 256).alias("identity")
    )


@query(
    "slugs_and_keys",
    """SELECT c_custkey AS id, trim(regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
      lower(regexp_replace(trim(regexp_replace(c_mktsegment, '[^A-Za-z0-9]+', ' ', 'g')), ' +', ' ', 'g')) AS locality,
      regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS make_key FROM customer""",
)
def slugs(t):
    """Slugs, locality keys and make keys."""
    return t.customer.select(
        F.col("c_custkey").alias("id"),
        T.slug(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("slug"),
        T.locality_key(F.concat("c_mktsegment", F.lit(", Portugal"))).alias("locality"),
        T.make_key(F.col("c_name")).alias("make_key"),
    )


@query(
    "match_text",
    """SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[‐‑‒–—―-]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS matched,
      sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed FROM documents""",
)
def match_texts(t):
    """Keyword form and collapsed form of every document."""
    return t.documents.select(
        "doc_id", F.sha2(T.match_text(F.col("text")), 256).alias("matched"), F.sha2(T.normalize_ws(F.col("text")), 256).alias("collapsed")
    )


@query(
    "doc_tokens",
    f"""WITH k AS (SELECT doc_id, {_TOKENS} AS tokens FROM documents)
    SELECT doc_id, CAST(len(tokens) AS INT) AS tokens, sha256(array_to_string(tokens, ' ')) AS digest FROM k""",
)
def doc_tokens(t):
    """Identity tokens of every document."""
    df = t.documents.select("doc_id", T.tokens(F.col("text")).alias("k"))
    return df.select("doc_id", F.size("k").alias("tokens"), F.sha2(F.array_join("k", " "), 256).alias("digest"))


@query(
    "doc_near_duplicates",
    f"""WITH k AS (SELECT doc_id, {_TOKENS} AS tokens FROM documents),
    c AS (SELECT tokens, min(doc_id) AS id, count(*) AS copies, len(tokens) AS n FROM k WHERE len(tokens) >= 5 GROUP BY tokens),
    e AS (SELECT id, n, copies, unnest(tokens) AS token FROM c),
    s AS (SELECT a.id AS left_id, b.id AS right_id, a.n AS ln, b.n AS rn, a.copies AS left_copies, b.copies AS right_copies, count(*) AS shared
      FROM e a JOIN e b ON a.token = b.token AND a.id < b.id GROUP BY ALL)
    SELECT left_id, right_id, left_copies, right_copies, floor(shared::DOUBLE / (ln + rn - shared) * 1000 + 0.5) / 1000 AS similarity
    FROM s WHERE floor(shared::DOUBLE / (ln + rn - shared) * 1000 + 0.5) / 1000 >= 0.55""",
)
def doc_near_duplicates(t):
    """Pairs of documents with similar tokens; copies are counted and not paired."""
    pairs, _ = near_duplicate_texts(t.documents, "doc_id", "text")
    return pairs.select("left_id", "right_id", "left_copies", "right_copies", "similarity")


@query(
    "doc_copy_classes",
    f"""WITH k AS (SELECT doc_id, {_TOKENS} AS tokens FROM documents)
    SELECT min(doc_id) AS class_id, count(*) AS copies, CAST(len(tokens) AS INT) AS tokens FROM k GROUP BY k.tokens""",
)
def doc_copy_classes(t):
    """Documents with equal tokens."""
    _, classes = near_duplicate_texts(t.documents, "doc_id", "text")
    return classes.select("class_id", "copies", F.size("tokens").alias("tokens"))


_EMAIL = r"(?i)\b[\w.+-]+@[\w.-]+\.\w{2,}\b"
_PHONE = r"(?:\+?\d[\s().-]*){9,}"
_LINK = r"(?i)(wa\.me|whatsapp|facebook\.com/(profile|people|user)|mailto:|tel:)"


@query(
    "contact_data_docs",
    f"""SELECT doc_id, regexp_matches(text, '{_EMAIL}') AS has_email, regexp_matches(text, '{_PHONE}') AS has_phone,
      (regexp_matches(text, '{_EMAIL}') OR regexp_matches(text, '{_PHONE}') OR regexp_matches(text, '{_LINK}')) AS contact,
      (regexp_matches(text, '{_EMAIL}') OR regexp_matches(text, '{_PHONE}') OR regexp_matches(text, '{_LINK}') OR regexp_matches(text, '(?i)https?://')) AS contact_or_link
      FROM documents""",
)
def contact_data(t):
    """Documents that carry contact data."""
    text = F.col("text")
    return t.documents.select(
        "doc_id",
        text.rlike(X.EMAIL).alias("has_email"),
        text.rlike(X.PHONE).alias("has_phone"),
        X.contains_contact_data(text).alias("contact"),
        X.contains_contact_data(text, with_links=True).alias("contact_or_link"),
    )


_MONTHLY = r"(?i)(\b(mensalidade|monthly|por m[eê]s|per month)\b|\b\d[\d., ]*\s*€\s*/\s*m[eê]s\b)"


@query(
    "doc_years",
    """WITH y AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\\b(?:19|20)\\d{2}\\b'), lambda x: CAST(x AS INT)), lambda x: x >= 1950 AND x <= 2027) AS years FROM documents)
    SELECT doc_id, years[1] AS year FROM y""",
)
def doc_years(t):
    """First plausible year in every document."""
    return t.documents.select("doc_id", X.year_in(F.col("text"), F.lit(2026)).alias("year"))


@query(
    "conversation_indicators",
    f"""SELECT conv_id, turn, regexp_matches(text, '(?i)\\b(financiamento|financing|finance available|cr[eé]dito autom[oó]vel)\\b') AS financing,
      regexp_matches(text, '{_MONTHLY}') AS monthly_payment, regexp_matches(text, '(?i)\\b(entrada|sinal|deposit|down payment)\\b') AS deposit,
      regexp_matches(text, '(?i)\\b(importad[oa]|imported|matr[ií]cula estrangeira|foreign registration)\\b') AS imported,
      CASE WHEN regexp_matches(text, '(?i)\\b(profissional|dealer|stand)\\b') THEN 'dealer' WHEN regexp_matches(text, '(?i)\\b(particular|private seller)\\b') THEN 'private' END AS seller_type
      FROM conversations""",
)
def conversation_indicators(t):
    """Warning words and seller type in conversations."""
    text = F.col("text")
    return t.conversations.select(
        "conv_id",
        "turn",
        text.rlike(X.INDICATOR_RULES["financing"]).alias("financing"),
        text.rlike(X.INDICATOR_RULES["monthly_payment"]).alias("monthly_payment"),
        text.rlike(X.INDICATOR_RULES["deposit"]).alias("deposit"),
        text.rlike(X.INDICATOR_RULES["imported"]).alias("imported"),
        X.seller_type(F.lit(None).cast("string"), text).alias("seller_type"),
    )


# Shown prices in the notations that occur, from order totals.
_PRICE = """CASE o_orderkey % 7
  WHEN 0 THEN concat('€ ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS {s}))
  WHEN 1 THEN concat(CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS {s}), '.', lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS {s}), 3, '0'), ' €')
  WHEN 2 THEN concat(CAST(CAST(floor(o_totalprice) AS BIGINT) AS {s}), ',', lpad(CAST(o_orderkey % 100 AS {s}), 2, '0'), ' €')
  WHEN 3 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS {s})
  WHEN 4 THEN 'Grátis'
  WHEN 5 THEN concat('€', CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS {s}), ',', lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS {s}), 3, '0'), '.5')
  ELSE 'contact seller' END"""


@query(
    "price_texts",
    f"""WITH p AS (SELECT o_orderkey AS id, {_PRICE.format(s='VARCHAR')} AS shown, CAST(floor(o_totalprice) AS BIGINT) AS euros, o_orderkey % 7 AS form FROM orders)
    SELECT id, shown, CASE form WHEN 0 THEN euros * 100 WHEN 1 THEN euros * 100 WHEN 2 THEN euros * 100 + id % 100 WHEN 4 THEN 0 WHEN 5 THEN (euros * 10 + 5) * 100 END AS cents,
      form <> 3 AS price_text FROM p""",
)
def price_texts(t):
    """Displayed prices in cents."""
    df = t.orders.selectExpr("o_orderkey AS id", f"{_PRICE.format(s='STRING')} AS shown")
    return df.select("id", "shown", parse_eur_cents(F.col("shown")).alias("cents"), is_price_text(F.col("shown")).alias("price_text"))


# Listing titles with makes, models, years, distances, power and fuels.
_MAKES = ["BMW", "Volkswagen", "Citroën", "Mercedes-Benz", "Peugeot", "Renault", "SEAT", "Opel", "Fiat", "Kia"]
_MAKE = "CASE p_partkey % 11 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MAKES)) + " ELSE 'Carro' END"
_TEXT = {
    "title": f"concat(CASE WHEN p_partkey % 2 = 0 THEN concat(CAST(1990 + p_size % 35 AS {{s}}), ' ') ELSE '' END, {_MAKE}, ' X', CAST(p_size AS {{s}}), ' ', p_type,"
    " CASE WHEN p_partkey % 5 = 0 THEN ' Manual' ELSE '' END)",
    "description": "CASE WHEN p_partkey % 4 <> 3 THEN concat('Ano: ', CAST(1980 + p_size AS {s}), ' km ', CAST(p_size * 3 AS {s}), CASE p_partkey % 3 WHEN 0 THEN '.000 km' WHEN 1 THEN 'k km' ELSE ' mil milhas' END,"
    " ', ', CAST(50 + p_size * 2 AS {s}), CASE WHEN p_partkey % 2 = 0 THEN ' cv' ELSE ' kW' END, CASE p_partkey % 6 WHEN 0 THEN ' gasóleo' WHEN 1 THEN ' TDI automático' WHEN 2 THEN ' híbrido plug-in' WHEN 3 THEN ' gasolina' ELSE '' END,"
    " CASE WHEN p_partkey % 10 = 0 THEN ' aceito financiamento' WHEN p_partkey % 10 = 1 THEN ' 150 € / mês com entrada' WHEN p_partkey % 10 = 2 THEN ' carro importado, acidentado' ELSE '' END,"
    " CASE WHEN p_partkey % 8 = 0 THEN ' Particular' WHEN p_partkey % 8 = 1 THEN ' Stand Profissional' ELSE '' END) END",
    "displayed_price": "CASE WHEN p_partkey % 9 <> 0 THEN concat(CAST(CAST(floor(p_retailprice) AS BIGINT) * 10 AS {s}), ' €') END",
}


def texts(t):
    """Listing texts derived from parts."""
    return t.part.selectExpr(
        "p_partkey AS listing_id", *[f"{e.format(s='STRING')} AS {n}" for n, e in _TEXT.items()], "array(p_name) AS card_facts"
    )


_MODEL_LINE = "'X' || p_size"
_TEXT_SQL = f"""
texts AS (SELECT p_partkey AS listing_id, p_partkey, p_size, p_type, p_name, p_retailprice, {", ".join(f"{e.format(s='VARCHAR')} AS {n}" for n, e in _TEXT.items())} FROM part),
facts AS (
  SELECT listing_id, title, description,
    CASE WHEN p_partkey % 9 <> 0 THEN CAST(floor(p_retailprice) AS BIGINT) * 1000 END AS price_cents,
    CASE WHEN p_partkey % 11 < 10 THEN {_MAKE} END AS make,
    CASE WHEN p_partkey % 11 < 10 THEN {_MODEL_LINE} END AS model,
    CASE WHEN p_partkey % 11 < 10 THEN p_type END AS variant,
    CASE WHEN p_partkey % 2 = 0 THEN 1990 + p_size % 35 WHEN description IS NOT NULL AND 1980 + p_size <= 2027 THEN 1980 + p_size END AS year,
    CASE WHEN description IS NOT NULL AND p_partkey % 3 < 2 THEN CAST(p_size AS BIGINT) * 3000 END AS mileage,
    CASE WHEN description IS NULL THEN NULL WHEN p_partkey % 6 = 0 THEN 'diesel' WHEN p_partkey % 6 = 1 THEN 'diesel'
      WHEN p_partkey % 6 = 2 THEN 'plug_in_hybrid' WHEN p_partkey % 6 = 3 THEN 'petrol' END AS fuel,
    CASE WHEN description IS NOT NULL AND p_partkey % 6 = 1 THEN 'automatic' WHEN p_partkey % 5 = 0 THEN 'manual' END AS gearbox,
    CASE WHEN description IS NOT NULL THEN CASE WHEN p_partkey % 2 = 0 THEN 50 + p_size * 2 ELSE CAST(floor((50 + p_size * 2) * 1.34102 + 0.5) AS INT) END END AS power_hp,
    CASE WHEN description IS NOT NULL AND p_partkey % 8 = 1 THEN 'dealer' WHEN description IS NOT NULL AND p_partkey % 8 = 0 THEN 'private' END AS seller_type,
    description IS NOT NULL AND p_partkey % 10 = 0 AS financing,
    description IS NOT NULL AND p_partkey % 10 = 1 AS monthly_payment,
    description IS NOT NULL AND p_partkey % 10 = 1 AS deposit,
    description IS NOT NULL AND p_partkey % 10 = 2 AS damaged,
    description IS NOT NULL AND p_partkey % 10 = 2 AS imported
  FROM texts
)"""


@query(
    "normalize_facts",
    "WITH " + _TEXT_SQL
    + """ SELECT listing_id, price_cents, make, model, variant, year, mileage, fuel, gearbox, power_hp, seller_type, financing,
      monthly_payment, deposit, damaged, imported FROM facts""",
)
def normalized(t):
    """Typed facts of listing texts."""
    return normalize_facts(texts(t), F.lit(2026)).select(
        "listing_id", "price_cents", "make", "model", "variant", "year", "mileage", "fuel", "gearbox", "power_hp", "seller_type",
        "financing", "monthly_payment", "deposit", "damaged", "imported",
    )


@query(
    "fact_evidence",
    "WITH " + _TEXT_SQL
    + """ SELECT listing_id, CASE WHEN p_partkey % 2 = 0 THEN title WHEN 1980 + p_size <= 2027 THEN description END AS year_evidence,
      CASE WHEN p_partkey % 3 < 2 THEN description END AS mileage_evidence,
      CASE WHEN p_partkey % 11 < 10 THEN title END AS make_evidence,
      CASE WHEN p_partkey % 10 = 0 THEN description END AS financing_evidence FROM texts""",
)
def fact_evidence(t):
    """Text that each fact was read from."""
    e = lambda name: F.get(F.try_element_at("evidence", F.lit(name)), F.lit(0))
    return normalize_facts(texts(t), F.lit(2026)).select(
        "listing_id",
        e("year").alias("year_evidence"),
        e("mileage").alias("mileage_evidence"),
        e("make").alias("make_evidence"),
        e("financing").alias("financing_evidence"),
    )


@query(
    "enrichment_fallback",
    "WITH " + _TEXT_SQL
    + """ SELECT listing_id, CASE WHEN monthly_payment THEN 'monthly_payment' WHEN deposit THEN 'deposit' WHEN price_cents IS NULL THEN 'unknown' ELSE 'full_price' END AS price_interpretation,
      concat_ws(',', CASE WHEN monthly_payment OR deposit OR price_cents IS NULL THEN 'price_interpretation' END, CASE WHEN make IS NULL OR model IS NULL THEN 'vehicle_identity' END,
        CASE WHEN year IS NULL THEN 'year' END, CASE WHEN mileage IS NULL THEN 'mileage' END, CASE WHEN fuel IS NULL THEN 'fuel' END, CASE WHEN gearbox IS NULL THEN 'transmission' END,
        CASE WHEN power_hp IS NULL THEN 'power' END, CASE WHEN seller_type IS NULL THEN 'seller_type' END, CASE WHEN NOT damaged THEN 'condition' END,
        CASE WHEN NOT imported THEN 'import_status' END) AS uncertainties FROM facts""",
)
def fallback(t):
    """Conservative enrichment of plain facts."""
    return enrichment_fallback(normalize_facts(texts(t), F.lit(2026))).select(
        "listing_id", "price_interpretation", F.array_join("uncertainties", ",").alias("uncertainties")
    )


@query(
    "enrichment_input",
    """WITH base AS (SELECT doc_id AS listing_id, lang AS title, text AS description FROM documents)
    SELECT listing_id, json_extract_string(j, '$.title') AS title, sha256(json_extract_string(j, '$.description')) AS description FROM (
      SELECT listing_id, json_object('title', title, 'description', description) AS j FROM base
      WHERE NOT (regexp_matches(description, '""" + _EMAIL + "') OR regexp_matches(description, '" + _PHONE + "') OR regexp_matches(description, '" + _LINK + "')))",
)
def model_input(t):
    """Payload for an external model; documents with contact data are left out."""
    df = t.documents.select(F.col("doc_id").alias("listing_id"), F.col("lang").alias("title"), F.col("text").alias("description"))
    columns = {c: F.lit(None).cast("string") for c in ("make", "model", "variant", "fuel", "gearbox", "seller_type")}
    columns |= {c: F.lit(None).cast("bigint") for c in ("price_cents", "year", "mileage", "power_hp")}
    columns |= {c: F.lit(False) for c in X.INDICATORS}
    out = enrichment_input(df.withColumns(columns))
    return out.select(
        "listing_id",
        F.get_json_object("payload", "$.title").alias("title"),
        F.sha2(F.get_json_object("payload", "$.description"), 256).alias("description"),
    )


@query(
    "seller_texts",
    "WITH " + _TEXT_SQL
    + """ SELECT listing_id, 'Good day, I saw your ' || coalesce(nullif(concat_ws(' ', year, make, model, variant), ''), trim(title)) ||
      ' and would like to come and see it. Is it for sale at the price shown, and what should I know about its past and its state? Kind regards.' AS message,
      CAST(4 + CAST(imported AS INT) + CAST(coalesce(seller_type = 'dealer', false) AS INT) AS INT) AS questions FROM facts""",
)
def seller_texts(t):
    """Message and questions to the seller."""
    n = normalize_facts(texts(t), F.lit(2026))
    c = F.col
    return n.select(
        "listing_id",
        seller_message(c("year"), c("make"), c("model"), c("variant"), c("title")).alias("message"),
        F.size(seller_questions(c("imported"), c("seller_type"))).alias("questions"),
    )


_ODO = "CASE WHEN p_partkey % 2 = 0 THEN 'MILES' ELSE 'KILOMETERS' END"


@query(
    "structured_values",
    f"""SELECT p_partkey AS listing_id, CASE WHEN p_size * 50 BETWEEN 1950 AND 2100 THEN p_size * 50 END AS year,
      CAST(floor(CASE WHEN p_partkey % 2 = 0 THEN p_size * 1000 * 1.609344 ELSE p_size * 1000 END + 0.5) AS BIGINT) AS mileage,
      CASE p_type WHEN 'ECONOMY' THEN 'other' ELSE 'other' END AS fuel,
      CASE WHEN p_size * 3 BETWEEN 20 AND 2000 THEN p_size * 3 END AS power_hp, split_part(p_name, ' ', 1) AS model,
      concat_ws(' ', split_part(p_name, ' ', 2), CASE WHEN p_partkey % 3 = 0 THEN p_type END) AS variant FROM part""",
)
def structured_values(t):
    """Marketplace values in their own units."""
    c = F.col
    trim = F.when(c("p_partkey") % 3 == 0, c("p_type"))
    return t.part.select(
        F.col("p_partkey").alias("listing_id"),
        X.structured_year((c("p_size") * 50).cast("double")).alias("year"),
        X.structured_odometer((c("p_size") * 1000).cast("double"), F.expr(_ODO)).alias("mileage"),
        X.structured_fuel(c("p_type")).alias("fuel"),
        X.structured_power((c("p_size") * 3).cast("double")).alias("power_hp"),
        X.split_model_display(c("p_name"), trim)["model"].alias("model"),
        X.split_model_display(c("p_name"), trim)["variant"].alias("variant"),
    )


@query(
    "rounding_and_ages",
    f"""SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_shipdate::VARCHAR AS shipped,
      floor((l_discount - 0.05) * 1000 / 7 * 10 + 0.5) / 10 AS one_digit,
      floor(date_diff('day', l_shipdate, TIMESTAMP '2024-06-30 12:00:00')) AS days,
      greatest(0, least(100, 2024 - CAST(year(l_shipdate) AS INT))) AS years FROM lineitem""",
)
def rounding(t):
    """Half-up rounding of negative values, ages in days and years."""
    now = M.evaluated_at()
    return t.lineitem.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped"),
        round_half_up((F.col("l_discount") - 0.05) * 1000 / 7, 1).alias("one_digit"),
        F.floor(age_days(F.col("l_shipdate"), now)).cast("double").alias("days"),
        vehicle_age(F.year("l_shipdate"), now).alias("years"),
    )


_HASH = "array_to_string([printf('%x', list_sum([CASE WHEN embedding[4 * n + b] > 0 THEN 1 << (4 - b) ELSE 0 END FOR b IN range(1, 5)])::BIGINT) FOR n IN range(16)], '')"


@query("dhash_vectors", f"SELECT vec_id, {_HASH} AS hash FROM embeddings")
def sign_hashes(t):
    """64-bit hash of every vector."""
    return t.embeddings.select("vec_id", sign_hash64(F.col("embedding")).alias("hash"))


_ALTERED = """(SELECT vec_id, label, embedding FROM embeddings UNION ALL
  SELECT vec_id + 1000000, label, [CASE WHEN i <= vec_id % 16 THEN -embedding[i] ELSE embedding[i] END FOR i IN range(1, 65)] FROM embeddings)"""


def altered_vectors(t):
    """Every vector, and a copy of which the first few components have changed their sign."""
    altered = F.transform("embedding", lambda v, i: F.when(i < F.col("vec_id") % 16, -v).otherwise(v))
    return t.embeddings.select("vec_id", "label", "embedding").unionByName(
        t.embeddings.select((F.col("vec_id") + 1_000_000).alias("vec_id"), "label", altered.alias("embedding"))
    )


@query(
    "hash_pairs",
    f"""WITH h AS (SELECT vec_id, label, {_HASH} AS hash FROM {_ALTERED}),
    b AS (SELECT *, ('0x' || substr(hash, 1, 8))::BIGINT AS hi, ('0x' || substr(hash, 9, 8))::BIGINT AS lo FROM h),
    p AS (SELECT a.vec_id AS left_id, c.vec_id AS right_id, floor((1 - (bit_count(xor(a.hi, c.hi)) + bit_count(xor(a.lo, c.lo))) / 64.0) * 1000 + 0.5) / 1000 AS similarity
      FROM b a JOIN b c ON a.label = c.label AND a.vec_id < c.vec_id)
    SELECT * FROM p WHERE similarity >= 0.82""",
)
def hash_pairs(t):
    """Vectors of one label, with altered copies, whose hashes differ in at most 11 bits."""
    h = altered_vectors(t).select("vec_id", "label", sign_hash64(F.col("embedding")).alias("hash"))
    pairs = image_candidates(h, "vec_id", "hash", ["label"])
    left = h.select(F.col("vec_id").alias("left_id"), F.col("hash").alias("lh"))
    right = h.select(F.col("vec_id").alias("right_id"), F.col("hash").alias("rh"))
    scored = pairs.join(left, "left_id").join(right, "right_id").withColumn("similarity", hash_similarity(F.col("lh"), F.col("rh")))
    return scored.filter("similarity >= 0.82").select("left_id", "right_id", "similarity")


@query(
    "vehicle_fingerprint",
    M.with_sql(M.LISTINGS_SQL)
    + """ SELECT listing_id, trim(regexp_replace(lower(make), '[^a-z0-9]+', ' ', 'g')) AS make, lower(model) AS model, lower(variant) AS variant, year, mileage,
      coalesce(trim(description) <> '', false) AS has_description, CASE WHEN price_interpretation = 'full_price' THEN price_cents END AS price_cents FROM listings""",
)
def vehicle_prints(t):
    """Comparison features of listings."""
    df = M.listings(t).withColumn("image_hash", F.lit(None).cast("string"))
    return fingerprints(df).select("listing_id", "make", "model", "variant", "year", "mileage", "has_description", "price_cents")


@query(
    "embedded_strings",
    """SELECT event_id, 'k=' || json_extract_string(props, '$.k') AS plain FROM events""",
)
def embedded_strings(t):
    """Embedded data is unquoted and read as JSON."""
    quoted = F.concat(F.lit("for (;;);"), F.replace(F.col("props"), F.lit('"'), F.lit("&quot;")))
    value = T.safe_json(T.unescape_embedded(quoted))
    return t.events.select(
        "event_id", T.unescape_string(F.concat(F.lit("k\\u003d"), F.try_variant_get(value, "$.k", "string"))).alias("plain")
    )


@query(
    "document_lines",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    c AS (SELECT doc_id, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM l)
    SELECT doc_id, count(*) AS lines, count(*) FILTER (line <> '' AND length(line) <= 200
      AND NOT (regexp_matches(line, '(?i)\\b[\\w.+-]+@[\\w.-]+\\.\\w{2,}\\b') OR regexp_matches(line, '(?:\\+?\\d[\\s().-]*){9,}')
        OR regexp_matches(line, '(?i)(wa\\.me|whatsapp|facebook\\.com/(profile|people|user)|mailto:|tel:)')
        OR regexp_matches(line, '(?i)https?://|www\\.|contact|perfil|profile|telefone|telem[oó]vel|pagamento|payment|iban|financiamento|prestaç|mensalidade|entrada|sinal|login|captcha'))) AS clean_lines
    FROM c GROUP BY doc_id""",
)
def document_lines(t):
    """Lines of each document that pass the allow list."""
    lines = T.drop_location_notes(F.split("text", "\n"))
    cleaned = F.array_compact(F.transform(lines, lambda line: X.clean_allowlisted(line, 200)))
    return t.documents.select("doc_id", F.size(lines).cast("bigint").alias("lines"), F.size(cleaned).cast("bigint").alias("clean_lines"))
