"""Pages: text, links, classes, cards, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions.urls import canonical_url, safe_image_url, safe_page_path
from lotwise.sources import pages as P
from lotwise.sources.embedded import embedded_facts
from workload import query

_HIDDEN = "(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>|<!--.*?-->|<!doctype[^>]*>"
_TEXT_SQL = (
    f"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '{_HIDDEN}', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),"
    " '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"
)


@query("page_text", f"SELECT page_id, sha256({_TEXT_SQL}) AS digest, length({_TEXT_SQL}) AS size FROM pages")
def page_text(t):
    """Visible text of every page."""
    df = t.pages.select("page_id", P.page_text(F.col("html")).alias("x"))
    return df.select("page_id", F.sha2("x", 256).alias("digest"), F.length("x").cast("bigint").alias("size"))


@query(
    "page_links",
    """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref="([^"]*)"', 1)) AS link FROM pages)
    SELECT page_id, count(*) AS links, count(DISTINCT link) AS targets, count(*) FILTER (link LIKE '/%') AS relative FROM l GROUP BY page_id""",
)
def page_links(t):
    """Links of every page."""
    df = t.pages.select("page_id", F.explode(P.page_links(F.col("html"))).alias("link"))
    return df.groupBy("page_id").agg(
        F.count("*").alias("links"), F.count_distinct("link").alias("targets"), F.count_if(F.col("link").startswith("/")).alias("relative")
    )


@query(
    "canonical_urls",
    """SELECT page_id, CASE WHEN regexp_matches(url, '^https://([a-z0-9-]+\\.)+example\\.(com|net|org)/[a-z]{2}/[0-9]+(\\?|#|$)') THEN regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) END AS id,
      CASE WHEN regexp_matches(url, '^https://([a-z0-9-]+\\.)+example\\.(com|net|org)/[a-z]{2}/[0-9]+(\\?|#|$)') THEN regexp_extract(url, '^[^?#]*') END AS canonical FROM pages""",
)
def canonical(t):
    """Canonical secure URL of pages; others are null."""
    found = canonical_url(F.col("url"), r"^(?:[a-z0-9-]+\.)+example\.(?:com|net|org)$", r"^/[a-z]{2}/([0-9]+)$")
    df = t.pages.select("page_id", found.alias("u"))
    return df.select("page_id", F.col("u.id").alias("id"), F.col("u.url").alias("canonical"))


@query(
    "safe_paths",
    """SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#]+$') THEN '/' ELSE
      '/' || array_to_string(list_transform(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> ''), lambda x: ':redacted'), '/')
      || CASE WHEN len(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '')) > 0 THEN '/' ELSE '' END END AS path FROM pages""",
)
def safe_paths(t):
    """Page paths without private segments."""
    return t.pages.select("page_id", safe_page_path(F.col("url")).alias("path"))


def _page_choice(part: int) -> str:
    """The page rules as one SQL choice that the text and the url decide."""
    cases = []
    for rule in P.PAGE_RULES:
        hits = [f"contains(url, '{x}')" for x in rule[2]] + ["contains(body, '{}')".format(x.replace("'", "''")) for x in rule[3]]
        cases.append(f"WHEN {' OR '.join(hits)} THEN '{rule[part]}'")
    return f"CASE {' '.join(cases)} END"


@query(
    "page_class",
    f"""WITH b AS (SELECT page_id, lower(url) AS url, lower({_TEXT_SQL}) || CASE page_id % 9 WHEN 0 THEN ' security checkpoint' WHEN 1 THEN ' log in to facebook' WHEN 2 THEN ' too many requests'
        WHEN 3 THEN ' no listings found' WHEN 4 THEN ' something went wrong' WHEN 5 THEN ' cookies on facebook' WHEN 6 THEN ' marketplace is not available to you' ELSE '' END AS body FROM pages)
    SELECT page_id, {_page_choice(0)} AS kind, {_page_choice(1)} AS scope FROM b""",
)
def page_class(t):
    """Kind of failure of each page."""
    notes = [
        " security checkpoint", " Log in to Facebook", " Too many requests", " no listings found", " Something went wrong",
        " cookies on Facebook", " marketplace is not available to you", "", "",
    ]
    note = F.get(F.array(*[F.lit(n) for n in notes]), (F.col("page_id") % 9).cast("int"))
    found = P.classify_page(F.col("url"), F.concat(P.page_text(F.col("html")), note))
    df = t.pages.select("page_id", found.alias("c"))
    return df.select("page_id", F.col("c.kind").alias("kind"), F.col("c.scope").alias("scope"))


@query(
    "stalled_pages",
    """SELECT event_id, CASE WHEN event_id % 4 < 2 AND user_id % 3 = 0 AND value >= 20 THEN 'partial_load' END AS kind FROM events""",
)
def stalled_pages(t):
    """Snapshots without cards that stay unchanged."""
    kind = P.classify_page(
        F.when(F.col("event_id") % 2 == 0, F.lit("https://x.example/marketplace/a")).otherwise(F.lit("https://x.example/other")),
        F.lit(""),
        F.when(F.col("user_id") % 3 == 0, 0).otherwise(5),
        (F.col("event_id") % 4 == 1),
        F.when((F.col("value") >= 20) & (F.col("event_id") % 4 < 2), 2).otherwise(1),
    )
    return t.events.select("event_id", kind["kind"].alias("kind"))


_FORBIDDEN = [
    ("scripts", "(?i)<script\\b"),
    ("forms", "(?i)<form\\b"),
    ("session data", "(?i)\\b(cookie|access_token|session_key|fb_dtsg)\\b"),
    ("email address", "(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b"),
    ("contact or profile link", "(?i)(tel:|mailto:|/profile\\.php|/people/)"),
    ("Portuguese phone number", "(?:\\+351\\s*)?(?:2[0-9]{8}|9[0-9]{8})\\b"),
    ("pending manual review", "(?i)reviewed:\\s*pending"),
    ("unreviewed inferred field", "REVIEW REQUIRED"),
]


@query(
    "privacy_audit",
    "SELECT page_id, concat_ws(',', "
    + ", ".join(f"CASE WHEN regexp_matches(html, '{p}') THEN '{n}' END" for n, p in _FORBIDDEN)
    + """) AS findings, len(list_filter(regexp_extract_all(html, '(?i)(?:href|src)="(https?:[^"#]+)"', 1), lambda u: NOT regexp_matches(u, '^https://[a-z.]*example\\.com/'))) AS links FROM pages""",
)
def privacy_audit(t):
    """Forbidden content and unapproved links of pages."""
    out = P.privacy_audit(t.pages, approved=[r"^https://[a-z.]*example\.com/"])
    return out.select("page_id", F.array_join("findings", ",").alias("findings"), F.size("unapproved_links").cast("bigint").alias("links"))


@query(
    "blocked_pages",
    f"""SELECT page_id, regexp_matches({_TEXT_SQL}, '(?i)request blocked|403 error|access denied|too many requests|verify you are human|verifique que [ée] humano|inicie sess[aã]o para continuar|log in to continue')
      OR regexp_matches(html, '(?i)<input\\b[^>]*\\btype="password"') AS blocked FROM pages""",
)
def blocked_pages(t):
    """Pages that hold results back."""
    return t.pages.select("page_id", P.is_blocked(F.col("html")).alias("blocked"))


@query(
    "contract_gate",
    "SELECT page_id FROM pages WHERE regexp_extract(html, '(?i)\\blang=\"([^\"]*)\"', 1) IN ('', '1')",
)
def contract_gate(t):
    """Pages of a supported layout version; here the declared language stands for it."""
    return P.contract_gate(t.pages, "html", "lang", 1).select("page_id")


@query(
    "page_leaf_texts",
    """SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) <> '' AS titled, len(regexp_extract_all(html, '(?i)<li>')) AS items FROM pages""",
)
def page_leaf_texts(t):
    """Nodes of every page: title and list items."""
    df = P.page_nodes(t.pages)
    titles = F.filter("nodes", lambda n: (n["tag"] == "title") & (P.text_of(F.col("nodes"), n) != ""))
    return df.select(
        "page_id", (F.size(titles) > 0).alias("titled"), F.size(F.filter("nodes", lambda n: n["tag"] == "li")).cast("bigint").alias("items")
    )


@query("article_counts", "SELECT page_id, len(regexp_extract_all(html, '(?i)<article\\b')) AS recognized, len(regexp_extract_all(html, '(?i)<article\\b')) AS rejected FROM pages WHERE len(regexp_extract_all(html, '(?i)<article\\b')) > 0")
def article_counts(t):
    """Articles without a listing link are rejected."""
    cards = P.extract_articles(t.pages)
    return P.card_counts(cards).select("page_id", "recognized", "rejected")


def over_cores(t, pages):
    """Spread few derived pages, which would otherwise end up in one task."""
    return pages.repartition(t.spark.sparkContext.defaultParallelism, "page_id")


def market_pages(t):
    """Result pages of 40 cards each, put together from parts."""
    card = F.format_string(
        '<div data-testid="item-card"><a href="/item/%d/?ref=%s"><img src="https://img.example/%d.jpg?x=1"></a><span>%s</span>'
        "<script>var a=1;</script><div><b>%s</b> %s</div><span>%s</span><i data-field=\"fact\">%d km</i></div>",
        F.when(F.col("p_partkey") % 10 == 9, F.col("p_partkey") - 1).otherwise(F.col("p_partkey")),
        F.col("p_type"),
        F.col("p_partkey"),
        F.when(F.col("p_partkey") % 7 == 3, F.lit("call +351 912 345 678")).otherwise(F.concat(F.floor("p_retailprice").cast("string"), F.lit(" €"))),
        F.col("p_brand"),
        F.col("p_name"),
        F.when(F.col("p_partkey") % 5 == 0, F.lit("diesel")).otherwise(F.lit("Porto")),
        F.col("p_size") * 1000,
    )
    cards = t.part.select((F.floor(F.col("p_partkey") / 40)).alias("page_id"), "p_partkey", card.alias("card"))
    # A page holds 40 cards at most.
    pages = cards.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "card"))).alias("c"))
    body = F.array_join(F.transform("c", lambda x: x["card"]), "\n")
    whole = pages.select("page_id", F.concat(F.lit("<!doctype html><html><body>"), body, F.lit("</body></html>")).alias("html"))
    return over_cores(t, whole)


_RULES = P.CardRules(image_host=r"^img\.example$")
_CARD_SQL = """WITH c AS (SELECT p_partkey // 40 AS page_id, CAST(p_partkey % 40 AS INT) AS card_index, CASE WHEN p_partkey % 10 = 9 THEN p_partkey - 1 ELSE p_partkey END AS item,
    CASE WHEN p_partkey % 7 = 3 THEN NULL ELSE CAST(floor(p_retailprice) AS BIGINT) || ' €' END AS price, p_partkey % 7 = 3 AS bad, p_brand, p_name, p_partkey, p_size FROM part)"""


@query(
    "page_cards",
    _CARD_SQL
    + """ SELECT page_id, card_index, CAST(item AS VARCHAR) AS source_listing_id, 'https://www.market.example/item/' || item || '/' AS url,
      CASE WHEN bad THEN 'call +351 912 345 678' ELSE p_brand END AS title, price AS displayed_price, 'https://img.example/' || p_partkey || '.jpg' AS thumbnail_url,
      bad AS rejected, NOT bad AND p_partkey % 10 = 9 AND (p_partkey - 1) // 40 = page_id AND NOT ((p_partkey - 1) % 7 = 3) AS repeated FROM c""",
)
def page_cards(t):
    """Cards of result pages, with shown text in place of missing labels."""
    cards = P.extract_cards(market_pages(t), _RULES)
    return cards.select(
        "page_id", "card_index", "source_listing_id", "url", "title", "displayed_price", "thumbnail_url",
        (F.size("reasons") > 0).alias("rejected"), "repeated",
    )


@query(
    "page_card_counts",
    _CARD_SQL
    + """ SELECT page_id, count(*) AS recognized, count(*) FILTER (bad) AS rejected, count(*) FILTER (NOT bad AND p_partkey % 10 = 9 AND NOT ((p_partkey - 1) % 7 = 3)) AS repeated,
      count(*) FILTER (NOT bad AND NOT (p_partkey % 10 = 9 AND NOT ((p_partkey - 1) % 7 = 3))) AS accepted FROM c GROUP BY page_id""",
)
def page_card_counts(t):
    """Card counts per result page."""
    return P.card_counts(P.extract_cards(market_pages(t), _RULES))


def article_pages(t):
    """Article result pages of 40 cards each, put together from parts."""
    card = F.format_string(
        '<article><h2><a href="/carros/anuncio/%s-ID%d.html">%s %s</a></h2><h3>%d %03d</h3><p>EUR</p><dd data-parameter="mileage">%d km</dd>'
        '<dd data-parameter="fuel_type">%s</dd><span data-testid="seller-type">%s</span><span data-testid="warranty">%s</span>'
        '<span data-testid="imported">%s</span><time datetime="2024-05-%02d"></time></article>',
        F.lower("p_type"),
        F.col("p_partkey"),
        F.col("p_brand"),
        F.col("p_name"),
        F.floor(F.col("p_retailprice") / 100).cast("bigint"),
        (F.col("p_partkey") % 1000).cast("bigint"),
        F.col("p_size") * 1000,
        F.when(F.col("p_size") % 2 == 0, F.lit("Diesel")).otherwise(F.lit("Gasolina")),
        F.when(F.col("p_partkey") % 3 == 0, F.lit("Profissional")).when(F.col("p_partkey") % 3 == 1, F.lit("Particular")).otherwise(F.lit("-")),
        F.when(F.col("p_partkey") % 4 == 0, F.lit("12 meses")).when(F.col("p_partkey") % 4 == 1, F.lit("Sem garantia")).otherwise(F.lit("?")),
        F.when(F.col("p_partkey") % 5 == 0, F.lit("Importado")).when(F.col("p_partkey") % 5 == 1, F.lit("Nacional")).otherwise(F.lit("?")),
        (F.col("p_partkey") % 28 + 1).cast("bigint"),
    )
    cards = t.part.select((F.floor(F.col("p_partkey") / 40)).alias("page_id"), "p_partkey", card.alias("card"))
    pages = cards.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "card"))).alias("c"))
    return over_cores(t, pages.select("page_id", F.array_join(F.transform("c", lambda x: x["card"]), "\n").alias("html")))


@query(
    "article_cards",
    """SELECT p_partkey // 40 AS page_id, CAST(p_partkey AS VARCHAR) AS source_listing_id, 'https://www.market.example/carros/anuncio/' || lower(p_type) || '-ID' || p_partkey || '.html' AS url,
      p_brand || ' ' || p_name AS title, CAST(floor(p_retailprice / 100) AS BIGINT) || ' ' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || ' €' AS displayed_price,
      CASE p_partkey % 3 WHEN 0 THEN 'dealer' WHEN 1 THEN 'private' END AS seller_type, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS warranty,
      CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS imported, '2024-05-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS posted_on,
      concat_ws('|', p_size * 1000 || ' km', CASE WHEN p_size % 2 = 0 THEN 'Diesel' ELSE 'Gasolina' END, CASE p_partkey % 3 WHEN 0 THEN 'Profissional' WHEN 1 THEN 'Particular' END,
        'Warranty: ' || CASE p_partkey % 4 WHEN 0 THEN '12 meses' WHEN 1 THEN 'Sem garantia' ELSE '?' END,
        CASE p_partkey % 5 WHEN 0 THEN 'Importado' WHEN 1 THEN 'Nacional' ELSE 'Origin: ?' END,
        'Posted: 2024-05-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00.000Z') AS card_facts FROM part""",
)
def article_cards(t):
    """Cards of article result pages."""
    rules = P.CardRules(path=r"^/carros/anuncio/[^/]+-ID([a-zA-Z0-9]+)\.html$", build=None)
    cards = P.extract_articles(article_pages(t), rules)
    return cards.select(
        "page_id", "source_listing_id", "url", "title", "displayed_price", "seller_type", "warranty", "imported",
        F.date_format("posted_at", "yyyy-MM-dd").alias("posted_on"), F.array_join("card_facts", "|").alias("card_facts"),
    )


def detail_pages(t):
    """Detail pages put together from parts: labelled values, equipment, description, script data."""
    def pair(label, value):
        return F.concat(F.lit(f"<div><div><p>{label}</p></div><div><p>"), value, F.lit("</p></div></div>"))

    html = F.concat(
        F.lit('<html><head><meta property="og:description" content="short"></head><body><div data-testid="combined-details-and-equipment-section">'),
        pair("Marca", F.col("p_brand")),
        pair("Modelo", F.col("p_type")),
        pair("Ano", (2000 + F.col("p_size")).cast("string")),
        F.when(F.col("p_partkey") % 9 == 0, pair("Ano", F.lit("1999"))).otherwise(F.lit("")),
        pair("Versão", F.when(F.col("p_partkey") % 7 == 0, F.lit("call 912 345 678 now")).otherwise(F.col("p_name"))),
        F.lit('</div><ul data-testid="content-equipments-section"><p>ABS</p><p>'),
        F.col("p_name"),
        F.lit("</p><p>ABS</p><p>contact us</p></ul><div><h3>Descrição</h3><div>"),
        F.concat(F.lit("Carro "), F.repeat(F.concat(F.col("p_name"), F.lit(" ")), 3)),
        F.lit("</div></div><script>{&quot;vehicle_make&quot;:&quot;"),
        F.col("p_brand"),
        F.lit("&quot;,&quot;vehicle_model_display_name&quot;:&quot;"),
        F.concat("p_type", F.lit(" "), "p_name"),
        F.lit("&quot;,&quot;vehicle_year&quot;:"),
        (1990 + F.col("p_size")).cast("string"),
        F.lit(",&quot;vehicle_odometer_data&quot;:{&quot;unit&quot;:&quot;"),
        F.when(F.col("p_partkey") % 2 == 0, F.lit("MILES")).otherwise(F.lit("KM")),
        F.lit("&quot;,&quot;value&quot;:"),
        (F.col("p_size") * 1000).cast("string"),
        F.lit("},&quot;vehicle_fuel_type&quot;:&quot;"),
        F.when(F.col("p_size") % 3 == 0, F.lit("GASOLINE")).when(F.col("p_size") % 3 == 1, F.lit("DIESEL")).otherwise(F.lit("PLUG_IN_HYBRID")),
        # Objects in objects, brackets inside texts, and a neighbour whose power is not this one's.
        F.lit("&quot;,&quot;neighbour&quot;:{&quot;specs&quot;:{&quot;horse_power&quot;:999}},&quot;vehicle_transmission&quot;:{&quot;meta&quot;:{&quot;deep&quot;:{}},&quot;name&quot;:{&quot;label&quot;:&quot;"),
        F.when(F.col("p_partkey") % 4 < 2, F.lit("Automática")).otherwise(F.lit("Manual")),
        F.lit("&quot;}},&quot;vehicle_specifications&quot;:{&quot;note&quot;:&quot;a } b { c&quot;,&quot;engine&quot;:{&quot;parts&quot;:[{&quot;x&quot;:{}}],"),
        F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("&quot;horse_power&quot;:{&quot;unit&quot;:{},&quot;value&quot;:"), (F.col("p_size") + 60).cast("string"), F.lit("}"))).otherwise(F.lit("&quot;y&quot;:1")),
        F.lit("}},&quot;vehicle_condition&quot;:&quot;USED&quot;,&quot;listing_condition&quot;:{&quot;value&quot;:&quot;PC_USED_"),
        F.when(F.col("p_partkey") % 2 == 0, F.lit("GOOD")).otherwise(F.lit("FAIR")),
        F.lit("&quot;}}</script></body></html>"),
    )
    return over_cores(t, t.part.select(F.col("p_partkey").alias("page_id"), html.alias("html")))


@query(
    "labelled_pairs",
    """SELECT p_partkey AS page_id, p_partkey % 9 = 0 AS conflict, CASE WHEN p_partkey % 9 <> 0 THEN p_brand END AS make, CASE WHEN p_partkey % 9 <> 0 THEN CAST(2000 + p_size AS VARCHAR) END AS year,
      CASE WHEN p_partkey % 9 <> 0 AND p_partkey % 7 <> 0 THEN p_name END AS variant FROM part""",
)
def labelled_pairs(t):
    """Labelled values of detail pages; contradictions reject the page."""
    out = P.extract_labelled_pairs(detail_pages(t))
    get = lambda k: F.try_element_at("details", F.lit(k)).alias(k)
    return out.select("page_id", "conflict", get("make"), get("year"), get("variant"))


def fact_pages(t):
    """Detail pages with every labelled fact, a seller in one of four places, a date and an address."""

    def pair(label, value, given=None):
        row = F.concat(F.lit(f"<div><div><p>{label}</p></div><div><p>"), value, F.lit("</p></div></div>"))
        return row if given is None else F.when(given, row).otherwise(F.lit(""))

    k, size = F.col("p_partkey"), F.col("p_size")
    number = lambda c: c.cast("bigint").cast("string")
    asked = F.concat(F.lit("https://www.market.example/carros/anuncio/x-ID"), number(k), F.lit(".html"))
    html = F.concat(
        F.lit('<html><head><link rel="canonical" href="'),
        F.when(k % 13 == 0, F.lit("https://www.market.example/other")).otherwise(F.concat(asked, F.lit("?ref=1"))),
        F.lit('"></head><body><div data-testid="content-description-section">'),
        F.when(k % 2 == 0, F.concat(F.lit('<time datetime="2024-05-'), F.lpad(number(k % 28 + 1), 2, "0"), F.lit('"></time>'))).otherwise(
            F.concat(F.lit("<p>Bom carro</p><p>"), number(k % 28 + 1), F.lit(" de março de 2024 às 10:30</p>"))
        ),
        F.lit('</div><section data-testid="combined-details-and-equipment-section">'),
        pair("Marca", F.when(k % 3 == 0, F.lit("bmw")).otherwise(F.col("p_brand"))),
        pair("Modelo", F.col("p_type")),
        pair("Versão", F.col("p_name")),
        pair("Ano", F.when(k % 11 == 0, F.lit("desde 2010")).otherwise(number(1990 + size))),
        pair("Ano", F.lit("1999"), k % 9 == 0),
        pair("Quilómetros", F.concat(number(size * 1000), F.when(k % 5 == 0, F.lit(" mi")).otherwise(F.lit(" km")))),
        pair("Combustível", F.when(k % 4 == 0, F.lit("Gasolina")).when(k % 4 == 1, F.lit("Gasóleo")).when(k % 4 == 2, F.lit("Diesel")).otherwise(F.lit("Outro"))),
        pair("Tipo de Caixa", F.when(k % 2 == 0, F.lit("Manual")).otherwise(F.lit("Automática"))),
        pair("Potência", F.concat(number(size + 60), F.when(k % 6 == 0, F.lit(" kW")).otherwise(F.lit(" cv")))),
        pair("Garantia", F.lit("12 meses"), k % 2 == 0),
        pair("Inspeção válida até", F.lit("maio de 2027"), k % 7 == 0),
        pair("Origem", F.when(k % 3 == 0, F.lit("Nacional")).otherwise(F.lit("Importado")), k % 3 < 2),
        pair("Anunciante", F.lit("Profissional"), k % 4 == 0),
        F.lit("<div><p>Cor</p><div><p>preto</p><p>mate</p></div></div></section>"),
        F.when(k % 4 == 1, F.lit('<i data-testid="seller-type">Particular</i>'))
        .when(k % 4 == 2, F.lit('<div data-testid="content-seller-area-section"><b>Ana</b><span>Profissional</span><a href="tel:1">x</a></div>'))
        .otherwise(F.lit("")),
        F.lit("</body></html>"),
    )
    return over_cores(t, t.part.select(k.alias("page_id"), asked.alias("url"), html.alias("html")))


@query(
    "detail_facts",
    """WITH f AS (SELECT p_partkey AS k, p_size AS size, p_partkey % 9 = 0 AND p_size + 1990 <> 1999 OR p_partkey % 9 = 0 AND p_partkey % 11 = 0 AS conflict, * FROM part)
    SELECT k AS page_id, conflict, CASE WHEN NOT conflict THEN CASE WHEN k % 3 = 0 THEN 'BMW' ELSE p_brand END END AS make, CASE WHEN NOT conflict THEN p_type END AS model,
      CASE WHEN NOT conflict THEN p_name END AS variant, CASE WHEN NOT conflict AND k % 11 <> 0 AND size + 1990 <= 2025 THEN 1990 + size END AS year,
      CASE WHEN NOT conflict THEN CAST(floor(CASE WHEN k % 5 = 0 THEN size * 1000 * 1.609344 ELSE size * 1000 END + 0.5) AS BIGINT) END AS mileage,
      CASE WHEN NOT conflict THEN CASE k % 4 WHEN 0 THEN 'petrol' WHEN 1 THEN 'diesel' WHEN 2 THEN 'diesel' END END AS fuel,
      CASE WHEN NOT conflict THEN CASE WHEN k % 2 = 0 THEN 'manual' ELSE 'automatic' END END AS gearbox,
      CASE WHEN NOT conflict THEN CAST(CASE WHEN k % 6 = 0 THEN floor((size + 60) * 1.34102 + 0.5) ELSE size + 60 END AS INT) END AS power_hp,
      CASE WHEN NOT conflict THEN CASE k % 4 WHEN 0 THEN 'dealer' WHEN 1 THEN 'private' WHEN 2 THEN 'dealer' END END AS seller_type,
      CASE WHEN NOT conflict THEN CASE k % 3 WHEN 0 THEN false WHEN 1 THEN true END END AS imported, CASE WHEN NOT conflict AND k % 2 = 0 THEN '12 meses' END AS warranty,
      CASE WHEN NOT conflict AND k % 7 = 0 THEN 'maio de 2027' END AS inspection,
      CASE WHEN NOT conflict THEN CASE WHEN k % 2 = 0 THEN '2024-05-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') ELSE (k % 28 + 1) || ' de março de 2024 às 10:30' END END AS posted,
      k % 13 <> 0 AS same_page FROM f""",
)
def detail_facts(t):
    """Typed facts, seller, origin, date and identity of detail pages."""
    return P.detail_facts(fact_pages(t), F.lit(2024), url="url").drop("canonical")


@query("equipment", "SELECT p_partkey AS page_id, 'ABS,' || p_name AS equipment FROM part")
def equipment(t):
    """Distinct cleaned equipment of detail pages."""
    df = P.page_nodes(detail_pages(t))
    return df.select("page_id", F.array_join(P.extract_equipment(F.col("nodes")), ",").alias("equipment"))


@query("detail_description", "SELECT p_partkey AS page_id, 'Carro ' || p_name || ' ' || p_name || ' ' || p_name AS description FROM part")
def detail_description(t):
    """Longest description candidate of detail pages."""
    df = P.page_nodes(detail_pages(t))
    return df.select("page_id", P.extract_detail_description(F.col("nodes")).alias("description"))


@query(
    "embedded_facts",
    """SELECT p_partkey AS page_id, p_brand AS make, p_type AS model, p_name AS variant, 1990 + p_size AS year,
      CAST(floor(CASE WHEN p_partkey % 2 = 0 THEN p_size * 1000 * 1.609344 ELSE p_size * 1000 END + 0.5) AS BIGINT) AS mileage,
      CASE p_size % 3 WHEN 0 THEN 'petrol' WHEN 1 THEN 'diesel' ELSE 'plug_in_hybrid' END AS fuel, CASE WHEN p_partkey % 4 < 2 THEN 'automatic' ELSE 'manual' END AS gearbox,
      CASE WHEN p_partkey % 5 > 0 THEN p_size + 60 END AS power_hp, 'USED' AS condition, CASE WHEN p_partkey % 2 = 0 THEN 'PC_USED_GOOD' ELSE 'PC_USED_FAIR' END AS listing_condition FROM part""",
)
def embedded(t):
    """Vehicle facts in script data of detail pages."""
    return embedded_facts(detail_pages(t))


@query(
    "sanitized_pages",
    "SELECT page_id, len(regexp_extract_all(html, '(?i)<li>')) AS items, len(regexp_extract_all(html, '(?i)<article\\b')) AS articles, false AS has_text FROM pages",
)
def sanitized(t):
    """Text-free skeleton of every page."""
    out = P.structural_sanitize(t.pages, "partial_load", "check", r"/item/([0-9]+)")
    body = F.regexp_replace("sanitized", "(?s)^.*?</header>", "")
    return out.select(
        "page_id",
        F.size(F.regexp_extract_all(body, F.lit("<li>"), F.lit(0))).cast("bigint").alias("items"),
        F.size(F.regexp_extract_all(body, F.lit("<article\\b"), F.lit(0))).cast("bigint").alias("articles"),
        F.regexp_replace(body, "<[^>]*>", "").rlike(r"\S").alias("has_text"),
    )


@query(
    "image_urls",
    """SELECT page_id, CASE WHEN regexp_matches(url, '^https://[^/@:]+\\.example\\.com(/|\\?|#|$)') THEN regexp_extract(url, '^[^?#]*') END AS image FROM pages""",
)
def image_urls(t):
    """Image URLs on allowed hosts, without query."""
    return t.pages.select("page_id", safe_image_url(F.col("url"), r"\.example\.com$").alias("image"))
