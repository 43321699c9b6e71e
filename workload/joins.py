"""Joins, overlays, precedence, distances and nested documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions.geo import approximate_km
from lotwise.operators import overlay as O
from lotwise.operators.geo import centroids, geocode_join
from lotwise.operators.history import misses_since_seen, missed_listings
from lotwise.operators.rank import next_capture_batch
from lotwise.plans.detail import listing_detail
from lotwise.plans.normalize import detail_merge
from lotwise.sources import tables as B
from workload import market as M
from workload import query


@query("scan_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def scan(t):
    """Columns of a table in key order."""
    return B.scan_table(t.nation, ["n_nationkey", "n_name", "n_regionkey"], ["n_nationkey"], F.col("n_regionkey") == 2)


@query(
    "join_scores_cohorts",
    """WITH s AS (SELECT l_orderkey AS listing_id, l_suppkey AS search_id, count(*) AS lines FROM lineitem GROUP BY ALL),
    c AS (SELECT l_orderkey AS listing_id, l_suppkey AS search_id, CAST(round(max(l_extendedprice) * 100) AS BIGINT) AS top FROM lineitem WHERE l_discount > 0.03 GROUP BY ALL)
    SELECT listing_id, search_id, lines, top FROM s JOIN c USING (listing_id, search_id)""",
)
def scores_cohorts(t):
    """Inner join on a key of two columns."""
    keys = [F.col("l_orderkey").alias("listing_id"), F.col("l_suppkey").alias("search_id")]
    s = t.lineitem.groupBy(*keys).agg(F.count("*").alias("lines"))
    c = t.lineitem.filter("l_discount > 0.03").groupBy(*keys).agg(F.round(F.max("l_extendedprice") * 100).cast("bigint").alias("top"))
    return s.join(c, ["listing_id", "search_id"])


@query(
    "group_members",
    "SELECT p_brand AS group_id, p_partkey AS listing_id, p_name AS title, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS rank FROM part",
)
def group_members(t):
    """Members of groups with their listings and ordinals."""
    from lotwise.operators.rank import rank_members

    members = t.part.select(F.col("p_brand").alias("group_id"), F.col("p_partkey").alias("listing_id"))
    titles = t.part.select(F.col("p_partkey").alias("listing_id"), F.col("p_name").alias("title"))
    ranked = rank_members(members.join(titles, "listing_id"), ["group_id"], ["listing_id"])
    return ranked.select("group_id", "listing_id", "title", F.col("rank").cast("bigint").alias("rank"))


@query("semi_visible", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_visible(t):
    """Rows with a match."""
    hits = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey").join(hits, "o_orderkey", "left_semi")


@query("anti_excluded", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND toxic = 1)")
def anti_excluded(t):
    """Rows without an excluding match."""
    return B.delete_keys(t.documents.select("doc_id"), t.labels.filter("toxic = 1"), ["doc_id"])


@query("version_backfill", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR l.quality <> 1")
def version_backfill(t):
    """Rows whose stored result is missing or of an older version."""
    stored = t.labels.select("doc_id", F.col("quality").alias("version"))
    return B.needs_version(t.documents.select("doc_id"), stored, "doc_id", 1)


@query(
    "delete_cascade",
    "SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey",
)
def delete_cascade(t):
    """Derived rows of parents that stay."""
    gone = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return B.delete_keys(t.lineitem, gone, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("lines"))


@query("retention_filter", "SELECT event_id FROM events WHERE event_type = 'error' AND ts + INTERVAL 7 DAY <= TIMESTAMP '2024-01-20'")
def retention(t):
    """Rows whose time is over."""
    expires = F.when(F.col("event_type") == "error", F.col("ts") + F.expr("INTERVAL 7 DAYS"))
    return B.retention_due(t.events, expires, F.lit("2024-01-20").cast("timestamp")).select("event_id")


@query(
    "known_in_search",
    f"""WITH f AS (SELECT l_partkey AS p, l_suppkey AS s, min(l_shipdate) AS first_at FROM lineitem GROUP BY ALL)
    SELECT l_suppkey AS search_id, count(*) AS cards, count(*) FILTER (l_shipdate > first_at) AS known FROM lineitem JOIN f ON p = l_partkey AND s = l_suppkey GROUP BY l_suppkey""",
)
def known_in_search(t):
    """Cards a search had seen before."""
    pair = ["l_partkey", "l_suppkey"]
    first = t.lineitem.groupBy(*pair).agg(F.min("l_shipdate").alias("first_at"))
    return t.lineitem.join(first, pair).groupBy(F.col("l_suppkey").alias("search_id")).agg(
        F.count("*").alias("cards"), F.count_if(F.col("l_shipdate") > F.col("first_at")).alias("known")
    )


_SCANS = """links AS (SELECT l_partkey AS listing_id, l_suppkey AS search_id, min(l_shipdate) AS first_seen_at FROM lineitem GROUP BY ALL),
seen AS (SELECT DISTINCT l_partkey AS listing_id, l_suppkey AS search_id, date_trunc('year', l_shipdate) + INTERVAL 1 YEAR AS scan_at FROM lineitem),
scans AS (SELECT DISTINCT search_id, scan_at, year(scan_at) % 2 = 0 AS complete_snapshot FROM seen)"""


def _scans(t):
    """(sights, scans): yearly scans, complete in even years."""
    at = (F.date_trunc("year", "l_shipdate") + F.expr("INTERVAL 1 YEAR")).alias("at")
    seen = t.lineitem.select(F.col("l_partkey").alias("listing_id"), F.col("l_suppkey").alias("search_id"), at).distinct()
    return seen, seen.select("search_id", "at").distinct().withColumn("complete_snapshot", F.year("at") % 2 == 0)


@query(
    "link_misses",
    f"WITH {_SCANS}"
    + """, last_sight AS (SELECT listing_id, search_id, max(scan_at) AS scan_at FROM seen JOIN scans USING (search_id, scan_at) WHERE complete_snapshot GROUP BY ALL)
    SELECT l.listing_id, l.search_id, count(s.scan_at) AS misses FROM links l LEFT JOIN last_sight o ON o.listing_id = l.listing_id AND o.search_id = l.search_id
      LEFT JOIN scans s ON s.search_id = l.search_id AND s.complete_snapshot AND s.scan_at > l.first_seen_at AND (o.scan_at IS NULL OR s.scan_at > o.scan_at) GROUP BY ALL""",
)
def link_misses(t):
    """Complete scans in a row, up to the last, that did not see a listing of their search."""
    return misses_since_seen(M.links(t), *_scans(t))


@query(
    "missed_listings",
    f"WITH {_SCANS}"
    + """ SELECT l.listing_id, l.search_id, CAST(year(s.scan_at) AS INT) AS scan_year FROM links l JOIN scans s USING (search_id)
      WHERE s.complete_snapshot AND l.first_seen_at < s.scan_at AND NOT EXISTS (SELECT 1 FROM seen o WHERE o.listing_id = l.listing_id AND o.search_id = l.search_id AND o.scan_at = s.scan_at)""",
)
def missed(t):
    """Listings that complete scans did not see again."""
    return missed_listings(M.links(t), *_scans(t)).select("listing_id", "search_id", F.year("at").alias("scan_year"))


@query(
    "cross_source_union",
    "SELECT source, count(*) AS rows, count(DISTINCT listing) AS listings FROM (SELECT 'a' AS source, l_partkey AS listing FROM lineitem UNION ALL SELECT 'b', p_partkey FROM part) GROUP BY source",
)
def cross_source(t):
    """Observations of two sources in one shape."""
    a = t.lineitem.select(F.lit("a").alias("source"), F.col("l_partkey").alias("listing"))
    b = t.part.select(F.col("p_partkey").alias("listing"), F.lit("b").alias("source"))
    return a.unionByName(b).groupBy("source").agg(F.count("*").alias("rows"), F.count_distinct("listing").alias("listings"))


_NATIONS = ["lisboa", "porto", "setubal", "sintra", "braga", "faro", "evora", "aveiro"]
_CITY = "CASE c_custkey % 10 " + " ".join(f"WHEN {i} THEN '{n.title()}, Portugal'" for i, n in enumerate(_NATIONS)) + " WHEN 8 THEN 'Atlantis' END"
_HOME = "CASE c_nationkey % 5 WHEN 0 THEN 'Lisbon, Portugal' WHEN 1 THEN 'Oporto' WHEN 2 THEN 'Nowhere' WHEN 3 THEN 'Évora' END"


def _geo_sql():
    from lotwise.operators.geo import CENTROIDS

    rows = ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in CENTROIDS.items())
    return f"""WITH places(k, lat, lon) AS (VALUES {rows}),
    c AS (SELECT c_custkey AS id, c_nationkey % 5 = 4 AS nationwide, CASE c_nationkey % 5 WHEN 0 THEN 'lisboa' WHEN 1 THEN 'porto' WHEN 2 THEN 'nowhere' WHEN 3 THEN 'evora' END AS origin,
      CASE WHEN c_custkey % 10 = 8 THEN 'atlantis' ELSE lower(split_part({_CITY}, ',', 1)) END AS listing FROM customer),
    j AS (SELECT c.*, o.lat AS olat, o.lon AS olon, l.lat AS llat, l.lon AS llon FROM c LEFT JOIN places o ON o.k = origin LEFT JOIN places l ON l.k = listing),
    h AS (SELECT *, pow(sin(radians(llat - olat) / 2), 2) + cos(radians(olat)) * cos(radians(llat)) * pow(sin(radians(llon - olon) / 2), 2) AS a FROM j),
    d AS (SELECT *, floor(6371.0088 * 2 * atan2(sqrt(a), sqrt(1 - a)) * 10 + 0.5) / 10 AS km FROM h),
    r AS (SELECT *, CASE WHEN nationwide THEN NULL WHEN listing IS NULL THEN 'missing_listing_locality' WHEN olat IS NULL THEN 'origin_not_found' WHEN llat IS NULL THEN 'listing_not_found' END AS reason FROM d)
    SELECT id, CASE WHEN nationwide THEN 'not_applicable' WHEN reason IS NOT NULL THEN 'unknown' ELSE 'approximate' END AS distance_status, reason AS distance_reason,
      CASE WHEN NOT nationwide AND reason IS NULL THEN km END AS distance_km, CASE WHEN NOT nationwide AND reason IS NULL THEN km <= 150 END AS within_radius,
      CASE WHEN nationwide THEN 'Nationwide search · distance not used' WHEN reason IS NOT NULL THEN 'Distance unknown' ELSE '≈ ' || printf('%.1f', km) || ' km straight-line' END AS distance_label FROM r"""


@query("geo_distance", _geo_sql())
def geo_distance(t):
    """Distance of listings from search origins."""
    df = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.expr(_CITY).alias("place"),
        F.expr(_HOME).alias("origin"),
        F.when(F.col("c_nationkey") % 5 == 4, F.lit("nationwide")).otherwise(F.lit("radius")).alias("mode"),
        F.lit(150).alias("radius"),
    )
    out = geocode_join(df, centroids(t.spark), "origin", "place", "mode", "radius")
    return out.select("id", "distance_status", "distance_reason", "distance_km", "within_radius", "distance_label")


@query(
    "distances",
    """WITH p AS (SELECT s_suppkey AS id, (s_suppkey * 7) % 181 - 90.0 AS lat, (s_suppkey * 13) % 361 - 180.0 AS lon FROM supplier),
    h AS (SELECT id, pow(sin(radians(lat - 38.7223) / 2), 2) + cos(radians(38.7223)) * cos(radians(lat)) * pow(sin(radians(lon + 9.1393) / 2), 2) AS a FROM p)
    SELECT id, floor(6371.0088 * 2 * atan2(sqrt(a), sqrt(1 - a)) * 10 + 0.5) / 10 AS km FROM h""",
)
def distances(t):
    """Great-circle distances over the whole globe."""
    lat, lon = ((F.col("s_suppkey") * 7) % 181 - 90).cast("double"), ((F.col("s_suppkey") * 13) % 361 - 180).cast("double")
    return t.supplier.select(F.col("s_suppkey").alias("id"), approximate_km(F.lit(38.7223), F.lit(-9.1393), lat, lon).alias("km"))


def _corrections(t):
    """Corrections from line items: a part's year, fuel or price is set, sometimes to unknown."""
    field = F.get(F.array(F.lit("year"), F.lit("fuel"), F.lit("price_cents")), (F.col("l_linenumber") % 3).cast("int"))
    value = (
        F.when(F.col("l_orderkey") % 5 == 0, F.lit(None).cast("string"))
        .when(F.col("l_linenumber") % 3 == 0, (1990 + F.col("l_orderkey") % 30).cast("string"))
        .when(F.col("l_linenumber") % 3 == 1, F.lit("petrol"))
        .otherwise((F.col("l_orderkey") * 100).cast("string"))
    )
    return t.lineitem.filter("l_returnflag = 'R'").select(
        F.col("l_partkey").alias("listing_id"),
        field.alias("field"),
        value.alias("value"),
        F.col("l_shipdate").alias("created_at"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
    )


_CORRECT = """fixes AS (SELECT l_partkey AS listing_id, l_linenumber % 3 AS f, (l_shipdate, l_orderkey * 10 + l_linenumber) AS place,
    CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_linenumber % 3 = 0 THEN CAST(1990 + l_orderkey % 30 AS VARCHAR) WHEN l_linenumber % 3 = 1 THEN 'petrol' ELSE CAST(l_orderkey * 100 AS VARCHAR) END AS v
  FROM lineitem WHERE l_returnflag = 'R'),
last AS (SELECT listing_id, f, v FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, f ORDER BY place DESC, v DESC NULLS LAST) AS n FROM fixes) WHERE n = 1)"""


@query(
    "overlay_corrections",
    M.with_sql(M.LISTINGS_SQL, _CORRECT)
    + """ SELECT l.listing_id, CASE WHEN a.listing_id IS NOT NULL THEN CAST(a.v AS INT) ELSE year END AS year, CASE WHEN b.listing_id IS NOT NULL THEN b.v ELSE fuel END AS fuel,
      CASE WHEN c.listing_id IS NOT NULL THEN CAST(c.v AS BIGINT) ELSE price_cents END AS price_cents,
      concat_ws(',', CASE WHEN b.listing_id IS NOT NULL THEN 'fuel' END, CASE WHEN c.listing_id IS NOT NULL THEN 'price_cents' END, CASE WHEN a.listing_id IS NOT NULL THEN 'year' END) AS corrected_fields
      FROM listings l LEFT JOIN last a ON a.listing_id = l.listing_id AND a.f = 0 LEFT JOIN last b ON b.listing_id = l.listing_id AND b.f = 1 LEFT JOIN last c ON c.listing_id = l.listing_id AND c.f = 2""",
)
def overlay(t):
    """Facts with the last correction of each field."""
    out = O.overlay_corrections(M.listings(t), _corrections(t))
    return out.select("listing_id", "year", "fuel", "price_cents", F.array_join("corrected_fields", ",").alias("corrected_fields"))


@query(
    "rule_join",
    M.with_sql(M.LISTINGS_SQL)
    + """, rules AS (SELECT p_brand AS v, max(p_partkey) AS last_id FROM part WHERE p_size % 10 = 3 GROUP BY p_brand)
      SELECT listing_id, CASE WHEN r.v IS NOT NULL THEN 'M' || last_id ELSE make END AS make, coalesce(fuel, 'other') AS fuel FROM listings LEFT JOIN rules r ON r.v = make""",
)
def rule_join(t):
    """Approved rules applied to equal values, unknown ones included."""
    rules = t.part.filter("p_size % 10 = 3").select(
        F.lit("make").alias("field"),
        F.col("p_brand").alias("source_value"),
        F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("value"),
        F.col("p_partkey").alias("decided_at"),
        F.col("p_partkey").alias("id"),
    )
    unknown = t.part.agg(F.max("p_partkey").alias("id")).select(
        F.lit("fuel").alias("field"), F.lit(None).cast("string").alias("source_value"), F.lit("other").alias("value"), F.col("id").alias("decided_at"), "id"
    )
    return O.apply_rules(M.listings(t), rules.unionByName(unknown)).select("listing_id", "make", "fuel")


@query(
    "validate_corrections",
    """SELECT field, count(*) AS corrections, count(*) FILTER (bad) AS invalid FROM (
      SELECT CASE l_linenumber % 4 WHEN 0 THEN 'year' WHEN 1 THEN 'fuel' WHEN 2 THEN 'gearbox' ELSE 'make' END AS field,
        CASE l_linenumber % 4 WHEN 0 THEN l_discount < 0.05 WHEN 1 THEN l_returnflag <> 'R' WHEN 2 THEN l_returnflag <> 'A' ELSE l_returnflag = 'N' END AS bad FROM lineitem) GROUP BY field""",
)
def check_corrections(t):
    """Corrections that do not fit their field."""
    flag = F.col("l_returnflag")
    rows = t.lineitem.select(
        F.get(F.array(F.lit("year"), F.lit("fuel"), F.lit("gearbox"), F.lit("make")), F.col("l_linenumber") % 4).alias("field"),
        F.when(F.col("l_linenumber") % 4 == 0, F.when(F.col("l_discount") < 0.05, F.lit("-3")).otherwise(F.lit("2001")))
        .when(F.col("l_linenumber") % 4 == 1, F.when(flag == "R", F.lit("diesel")).otherwise(F.lit("steam")))
        .when(F.col("l_linenumber") % 4 == 2, F.when(flag == "A", F.lit("manual")).otherwise(F.lit("none")))
        .otherwise(F.when(flag == "N", F.lit(" ")).otherwise(F.lit("BMW")))
        .alias("value"),
    )
    return O.validate_corrections(rows).groupBy("field").agg(F.count("*").alias("corrections"), F.count_if(F.col("issue").isNotNull()).alias("invalid"))


@query(
    "rule_proposals",
    """WITH p AS (SELECT l_orderkey AS correction_id, min(l_partkey) AS id FROM lineitem GROUP BY l_orderkey),
    d AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'approved' ELSE 'rejected' END AS decision FROM part WHERE p_size > 20)
    SELECT p.correction_id, p.id, coalesce(decision, 'pending') AS status FROM p LEFT JOIN d USING (id)""",
)
def proposals(t):
    """Rule proposals with their first decision."""
    rows = t.lineitem.select(
        F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("correction_id"), F.lit("make").alias("field"),
        F.lit("a").alias("source_value"), F.lit("b").alias("value"), F.col("l_partkey").alias("created_at"),
    )
    first = t.part.filter("p_size > 20").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, F.lit("approved")).otherwise(F.lit("rejected")).alias("decision"), F.lit(1).alias("decided_at")
    )
    later = first.select("id", F.lit("approved").alias("decision"), F.lit(2).alias("decided_at"))
    return O.rule_proposals(rows, first.unionByName(later)).select("correction_id", "id", "status")


@query(
    "approved_rules",
    "SELECT p_partkey AS id, p_brand AS source_value FROM part WHERE p_size % 3 = 0",
)
def approved(t):
    """Approved rules in order of decision."""
    df = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("source_value"), F.col("p_size").alias("decided_at"), F.when(F.col("p_size") % 3 == 0, F.lit("approved")).otherwise(F.lit("pending")).alias("status"))
    return O.approved_rules(df).select("id", "source_value")


def _sources(t):
    facts = M.listings(t).withColumns(
        {
            "normalized_at": F.lit("2024-01-10").cast("timestamp"),
            "corrected_fields": F.when(F.col("listing_id") % 5 == 0, F.array(F.lit("year"))).otherwise(F.array().cast("array<string>")),
        }
    )
    p = t.part
    enrichments = p.filter("p_partkey % 2 = 0").select(
        F.col("p_partkey").alias("listing_id"),
        F.when(F.col("p_partkey") % 8 == 0, F.lit("2024-01-01")).otherwise(F.lit("2024-01-10")).cast("timestamp").alias("source_normalized_at"),
        F.lit(None).cast("string").alias("make"), F.lit(None).cast("string").alias("model"), F.lit("AI").alias("variant"),
        F.lit(2015).alias("year"), F.lit(None).cast("bigint").alias("mileage"), F.lit("hybrid").alias("fuel"),
        F.lit(None).cast("string").alias("gearbox"), F.lit(None).cast("int").alias("power_hp"), F.lit(None).cast("string").alias("seller_type"),
        (F.col("p_partkey") * 100).alias("amount_cents"), F.when(F.col("p_partkey") % 6 == 0, F.lit("deposit")).otherwise(F.lit("full_price")).alias("interpretation"),
        F.lit(False).alias("financing"), F.lit(False).alias("monthly_payment"), F.lit(False).alias("deposit"),
        (F.col("p_partkey") % 4 == 0).alias("damaged"), F.lit(True).alias("imported"), F.lit(0).alias("uncertainty_count"),
    )
    structured = p.filter("p_partkey % 3 = 0").select(
        F.col("p_partkey").alias("listing_id"), F.lit(None).cast("string").alias("make"), F.lit(None).cast("string").alias("model"),
        F.lit(None).cast("string").alias("variant"), F.lit(2018).alias("year"), F.lit(None).cast("bigint").alias("mileage"),
        F.lit("lpg").alias("fuel"), F.lit(None).cast("string").alias("gearbox"), F.lit(99).alias("power_hp"),
        F.lit("dealer").alias("seller_type"), F.when(F.col("p_partkey") % 9 == 0, F.lit(False)).alias("imported"),
    )
    return facts, enrichments, structured


@query(
    "resolve_listing",
    M.with_sql(M.LISTINGS_SQL)
    + """, r AS (SELECT *, listing_id % 2 = 0 AND listing_id % 8 <> 0 AS ai, listing_id % 3 = 0 AS st, listing_id % 5 = 0 AS fixed FROM listings)
    SELECT listing_id, ai AS enriched, CASE WHEN ai THEN 'AI' ELSE variant END AS variant,
      CASE WHEN NOT ai OR fixed THEN year WHEN st THEN 2018 ELSE 2015 END AS year, CASE WHEN NOT ai THEN fuel WHEN st THEN 'lpg' ELSE 'hybrid' END AS fuel,
      CASE WHEN ai AND st THEN 99 ELSE power_hp END AS power_hp, CASE WHEN ai AND st THEN 'dealer' ELSE seller_type END AS seller_type,
      CASE WHEN ai THEN damaged OR listing_id % 4 = 0 ELSE damaged END AS damaged, CASE WHEN ai THEN NOT (st AND listing_id % 9 = 0) ELSE imported END AS imported,
      CASE WHEN ai THEN CASE WHEN listing_id % 6 = 0 THEN 'deposit' ELSE 'full_price' END WHEN monthly_payment THEN 'monthly_payment' WHEN deposit THEN 'deposit' WHEN price_cents IS NULL THEN 'unknown' ELSE 'full_price' END AS price_interpretation,
      CASE WHEN ai AND listing_id % 6 <> 0 THEN listing_id * 100 ELSE price_cents END AS price_cents FROM r""",
)
def resolve(t):
    """Facts for valuation out of corrections, marketplace data, model output and text."""
    out = O.resolve_listing(*_sources(t))
    return out.select(
        "listing_id", "enriched", "variant", "year", "fuel", "power_hp", "seller_type", "damaged", "imported", "price_interpretation", "price_cents"
    )


@query(
    "fact_conflicts",
    M.with_sql(M.LISTINGS_SQL)
    + """ SELECT listing_id, concat_ws(',', CASE WHEN listing_id % 4 <> 1 THEN 'make' END, CASE WHEN fuel IS NOT NULL AND listing_id % 5 = 0 THEN 'fuel' END,
      CASE WHEN mileage <> (listing_id % 100) * 1000 THEN 'mileage' END) AS conflicts,
      CASE WHEN listing_id % 3 = 0 THEN 'structured' WHEN listing_id % 3 = 1 THEN 'description' WHEN mileage > 100000 THEN 'card' ELSE 'none' END AS mileage_source FROM listings""",
)
def conflicts(t):
    """Fields on which sources disagree, and where the mileage came from."""
    df = M.listings(t)
    own = F.struct("make", "fuel", "mileage").alias("structured")
    text = F.struct(
        F.when(F.col("listing_id") % 4 == 1, F.concat(F.lit(" "), F.upper("make"))).otherwise(F.lit("Other")).alias("make"),
        F.when(F.col("listing_id") % 5 == 0, F.lit("petrol")).alias("fuel"),
        ((F.col("listing_id") % 100) * 1000).alias("mileage"),
    ).alias("text")
    out = O.fact_conflicts(df.select("listing_id", "mileage", own, text), ["make", "fuel", "mileage"])
    source = O.mileage_provenance(
        F.when(F.col("listing_id") % 3 == 0, F.col("mileage")), F.when(F.col("listing_id") % 3 == 1, F.col("mileage")), F.when(F.col("mileage") > 100000, F.col("mileage"))
    )
    return out.select("listing_id", F.array_join("conflicts", ",").alias("conflicts"), source.alias("mileage_source"))


@query(
    "detail_merge",
    """SELECT p_partkey AS listing_id, 2020 AS selected_year, CAST(p_size AS BIGINT) * 1000 AS text_mileage, CAST(p_size AS BIGINT) * 2000 AS card_mileage,
      CASE WHEN p_partkey % 2 = 0 THEN 'structured' ELSE 'description' END AS mileage_source,
      concat_ws(',', 'year', CASE WHEN p_partkey % 2 = 0 THEN 'mileage' END) AS conflicts FROM part""",
)
def merged_details(t):
    """Description, card and marketplace facts of captured detail pages."""
    listings = t.part.select(
        F.col("p_partkey").alias("listing_id"), F.concat(F.lit("BMW "), "p_type").alias("title"), F.lit(None).cast("string").alias("description"),
        F.lit("1000 €").alias("displayed_price"), F.array(F.concat((F.col("p_size") * 2000).cast("string"), F.lit(" km"))).alias("card_facts"),
    )
    structured = F.struct(
        F.lit(None).cast("string").alias("make"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("variant"),
        F.lit(2020).alias("year"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("bigint") * 3000).alias("mileage"),
        F.lit(None).cast("string").alias("fuel"), F.lit(None).cast("string").alias("gearbox"), F.lit(None).cast("int").alias("power_hp"),
        F.lit(None).cast("string").alias("seller_type"), F.lit(None).cast("boolean").alias("imported"),
    )
    details = t.part.select(
        F.col("p_partkey").alias("listing_id"), F.concat((F.col("p_size") * 1000).cast("string"), F.lit(" km, 2019")).alias("detail_description"), structured.alias("structured")
    )
    out = detail_merge(listings, details, F.lit(2024))
    return out.select(
        "listing_id", F.col("selected.year").alias("selected_year"), F.col("text.mileage").alias("text_mileage"), F.col("card.mileage").alias("card_mileage"),
        "mileage_source", F.array_join("conflicts", ",").alias("conflicts"),
    )


@query(
    "next_capture_batch",
    M.with_sql(M.LISTINGS_SQL, M.MATCH_SQL)
    + """, open AS (SELECT m.search_id, m.listing_id, m.match_status, m.fit_percent, m.last_seen_at FROM matched m
      WHERE availability = 'active' AND match_status <> 'excluded' AND listing_id % 12 >= 3 AND (listing_id % 7 <> 0 OR listing_id % 2 = 0) AND (listing_id % 5 <> 0 OR listing_id % 10 = 0)),
    n AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY CASE WHEN match_status = 'needs_information' THEN 0 ELSE 1 END, coalesce(CASE WHEN match_status = 'matches' THEN fit_percent END, -1) DESC,
      last_seen_at DESC NULLS LAST, listing_id) AS rank FROM open)
    SELECT search_id, listing_id, CAST(rank AS INT) AS rank FROM n WHERE rank <= 5""",
)
def capture_batch(t):
    """Next five detail pages of each search."""
    from lotwise.operators.matching import personal_fit
    from workload.search import matches

    now = F.lit("2024-06-30").cast("timestamp")
    m = personal_fit(matches(t))
    scores = m.filter("match_status = 'matches'").select("listing_id", "search_id", "fit_percent", F.lit(0.0).alias("ordering_key"))
    ids = t.part.select(F.col("p_partkey").alias("listing_id"))
    details = ids.filter("listing_id % 7 = 0").withColumn(
        "captured_at", F.when(F.col("listing_id") % 2 == 0, F.lit("2024-06-01")).otherwise(F.lit("2024-06-29")).cast("timestamp")
    )
    attempts = ids.filter("listing_id % 5 = 0").select(
        "listing_id", F.lit("failed").alias("state"), F.when(F.col("listing_id") % 10 == 0, F.lit("2024-06-01")).otherwise(F.lit("2024-07-29")).cast("timestamp").alias("next_attempt_at")
    )
    out = next_capture_batch(
        M.listings(t).select("listing_id", "availability", "last_seen_at"), m.select("listing_id", "search_id", "match_status"), scores, details, attempts,
        ids.filter("listing_id % 12 < 3"), now, F.lit("2024-06-23").cast("timestamp"),
    )
    return out.select("search_id", "listing_id", "rank")


@query(
    "detail_document",
    f"""WITH w AS (SELECT o_orderkey AS listing_id, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'P')
    SELECT listing_id, o_orderpriority, count(l_orderkey) AS lines, coalesce(string_agg(CASE WHEN l_orderkey IS NOT NULL THEN l_linenumber || ':' || l_partkey END, ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS digest
    FROM w LEFT JOIN lineitem ON l_orderkey = listing_id GROUP BY listing_id, o_orderpriority""",
)
def detail_document(t):
    """Nested documents of the orders under way, as a digest of their lines."""
    head = t.orders.select(F.col("o_orderkey").alias("listing_id"), "o_orderpriority")
    wanted = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("listing_id"))
    lines = t.lineitem.withColumnRenamed("l_orderkey", "listing_id")
    doc = listing_detail(head, wanted, {"lines": (lines, ["l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity"])})
    shown = F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"]))
    return doc.select(
        "listing_id", "o_orderpriority", F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("lines"), F.coalesce(F.array_join(shown, ","), F.lit("")).alias("digest")
    )


@query("history_sorted", f"SELECT user_id, count(*) AS events, sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id)) AS digest FROM events GROUP BY user_id")
def history_sorted(t):
    """Events of each listing in time order."""
    from lotwise.operators.history import history_document

    doc = history_document(t.events, "user_id", ["ts", "event_id"], ["value"], "events")
    ids = F.array_join(F.transform("events", lambda e: e["event_id"].cast("string")), ",")
    return doc.select("user_id", F.size("events").cast("bigint").alias("events"), F.sha2(ids, 256).alias("digest"))
