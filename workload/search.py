"""Saved searches: matching, fit, classification, risk, searches as data."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions.keys import criteria_fingerprint, sha256_key
from lotwise.functions.text import model_target_key
from lotwise.operators.classify import classify_titles, default_rules, plain_pattern, risk_flags
from lotwise.operators.matching import best_match_status, evaluate_criteria, fan_out, personal_fit, plausible_listings
from lotwise.operators import rules as R
from lotwise.operators.quality import RADII, issue_counts, model_batch, normalize_searches, validate_searches
from lotwise.operators.rank import inbox_filter, inbox_join, rank_members, search_order, summary_counts
from lotwise.operators.scans import eligible_searches, verification_state
from workload import market as M
from workload import query

_MATCHED = M.with_sql(M.LISTINGS_SQL, M.MATCH_SQL)


def matches(t):
    return evaluate_criteria(fan_out(risk_flags(M.listings(t)), M.links(t), M.searches(t)))


@query(
    "criteria_match_status",
    _MATCHED + " SELECT listing_id, search_id, match_status, failures AS hard_failures, missing AS missing_criteria, soft FROM matched",
)
def criteria_match_status(t):
    """Every listing against every search that saw it."""
    return matches(t).select(
        "listing_id",
        "search_id",
        "match_status",
        F.size("hard_failures").alias("hard_failures"),
        F.size("missing_criteria").alias("missing_criteria"),
        F.size("soft_contributions").alias("soft"),
    )


@query(
    "soft_fit",
    _MATCHED
    + """ SELECT listing_id, search_id, fit_matched, fit_missed, soft - fit_matched - fit_missed AS fit_unknown, fit_percent,
      CASE WHEN soft = 0 THEN 'no_preferences' WHEN fit_matched + fit_missed = 0 THEN 'needs_information'
        WHEN soft > fit_matched + fit_missed THEN 'partial' ELSE 'assessed' END AS fit_status FROM matched""",
)
def soft_fit(t):
    """Fit of soft preferences."""
    return personal_fit(matches(t)).select(
        "listing_id", "search_id", "fit_matched", "fit_missed", "fit_unknown", "fit_percent", "fit_status"
    )


@query(
    "best_match_status",
    _MATCHED
    + """ SELECT listing_id, CASE max(CASE match_status WHEN 'matches' THEN 2 WHEN 'needs_information' THEN 1 ELSE 0 END)
      WHEN 2 THEN 'matches' WHEN 1 THEN 'needs_information' ELSE 'excluded' END AS best_status FROM matched GROUP BY listing_id""",
)
def best_status(t):
    return best_match_status(matches(t))


@query("plausible_listings", _MATCHED + " SELECT DISTINCT listing_id FROM matched WHERE match_status <> 'excluded'")
def plausible(t):
    return plausible_listings(matches(t))


@query(
    "criteria_explanations",
    _MATCHED
    + """ SELECT explanation, count(*) AS uses FROM (
      SELECT coalesce('price normalized as ' || price_cents, 'price is unknown') AS explanation FROM matched WHERE price_hard AND coalesce(NOT m_price, true)
      UNION ALL SELECT coalesce('year normalized as ' || year, 'year is unknown') FROM matched WHERE min_year IS NOT NULL AND coalesce(NOT m_year, true))
      GROUP BY explanation""",
)
def criteria_explanations(t):
    """Texts of failed or undecided hard price and year rules."""
    items = matches(t).select(F.explode(F.concat("hard_failures", "missing_criteria")).alias("i"))
    return items.filter(F.col("i.criterion").isin("price_range", "minimum_year")).groupBy(
        F.col("i.explanation").alias("explanation")
    ).agg(F.count("*").alias("uses"))


def _values(rows):
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)


_TITLE = """CASE p_partkey % 12 WHEN 0 THEN 'Hot Wheels ' WHEN 1 THEN 'Módulos de bateria – ' WHEN 2 THEN 'Catálogo '
  WHEN 3 THEN 'PARA-CHOQUE / capô ' WHEN 4 THEN 'Só para peças: ' WHEN 5 THEN 'Miniatura 1/18 ' WHEN 6 THEN 'Jante/pneus ' ELSE '' END"""

_RULES_SQL = f"""
rules(category, pattern, position) AS (VALUES {", ".join(f"('{c}', '{plain_pattern(p)}', {i})" for i, (c, p) in enumerate(default_rules()))}),
titles AS (SELECT p_partkey AS listing_id, concat({_TITLE}, p_name, ' ', p_type) AS title FROM part),
plain AS (SELECT listing_id, trim(regexp_replace(regexp_replace(strip_accents(lower(title)), '[‐‑‒–—―-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM titles),
hits AS (
  SELECT p.listing_id, r.category, r.position, r.pattern, max(CASE WHEN r.category = 'parts_only' THEN 1 ELSE 0 END) OVER (PARTITION BY p.listing_id) AS only_parts
  FROM plain p JOIN rules r ON regexp_matches(p.title, '(^|[^a-z0-9])' || r.pattern || '($|[^a-z0-9])')
)"""


@query(
    "classify_title",
    "WITH "
    + _RULES_SQL
    + """, kept AS (SELECT * FROM hits WHERE NOT (only_parts = 1 AND pattern = 'pecas'))
    SELECT p.listing_id,
      CASE WHEN bool_or(category = 'collectible') THEN 'collectible' WHEN bool_or(category = 'printed_material') THEN 'printed_material'
        WHEN bool_or(category = 'parts_only') THEN 'whole_vehicle' WHEN count(category) > 0 THEN 'part_or_accessory' ELSE 'unknown' END AS subject,
      CASE WHEN bool_or(category = 'parts_only') THEN 'parts_only' ELSE 'unknown' END AS condition,
      CASE WHEN count(category) > 0 THEN 'exclude' ELSE 'continue' END AS decision, CAST(count(category) AS INT) AS patterns,
      coalesce(string_agg(category, ',' ORDER BY position), '') AS categories
    FROM plain p LEFT JOIN kept USING (listing_id) GROUP BY p.listing_id""",
)
def classify_title(t):
    """Keyword classes of listing titles."""
    titles = t.part.selectExpr("p_partkey AS listing_id", f"concat({_TITLE}, p_name, ' ', p_type) AS title")
    return classify_titles(titles).select(
        "listing_id",
        "subject",
        "condition",
        "decision",
        F.size("matched_patterns").alias("patterns"),
        F.array_join(F.transform("matched_patterns", lambda m: m["category"]), ",").alias("categories"),
    )


@query(
    "risk_flags",
    M.with_sql(M.LISTINGS_SQL)
    + """ SELECT listing_id, high_risk, CAST(risk_count AS INT) AS reasons,
      concat_ws(',', CASE WHEN financing THEN 'financing_price' END, CASE WHEN price_cents > 0 AND price_cents < 100000 THEN 'suspiciously_low_price' END,
        CASE WHEN damaged THEN 'damaged_vehicle' END, CASE WHEN imported THEN 'imported_vehicle' END) AS codes FROM flagged""",
)
def risk(t):
    """Risk flags of listings."""
    return risk_flags(M.listings(t)).select(
        "listing_id",
        "high_risk",
        F.size("risk_reasons").alias("reasons"),
        F.array_join(F.transform("risk_reasons", lambda r: r["code"]), ",").alias("codes"),
    )


@query(
    "criteria_fingerprint",
    """SELECT s_suppkey AS search_id, sha256(concat('{"max_price":', 9000 + (s_suppkey * 37) % 8000, ',"min_year":',
      coalesce(CAST(CASE WHEN s_suppkey % 3 = 0 THEN 2000 + s_suppkey % 8 END AS VARCHAR), 'null'), ',"name":"', s_name, '"}')) AS fingerprint,
      sha256(s_name) AS name_key FROM supplier""",
)
def fingerprint(t):
    """Digests of search criteria."""
    s = t.supplier.selectExpr(
        "s_suppkey AS search_id",
        "s_name",
        f"{M.SEARCH['price_max']} AS price_max",
        f"{M.SEARCH['min_year']} AS min_year",
    )
    return s.select(
        "search_id",
        criteria_fingerprint(name=F.col("s_name"), max_price=F.col("price_max"), min_year=F.col("min_year")).alias("fingerprint"),
        sha256_key(F.col("s_name")).alias("name_key"),
    )


_VERIFY = {"seen": "s_suppkey % 4 <> 3", "changed": "s_suppkey % 4 = 2", "scope": "CASE WHEN s_suppkey % 10 = 0 THEN 'broad' ELSE 'targeted' END"}


def _verified(t):
    s = t.supplier.selectExpr(
        "s_suppkey AS search_id",
        f"{_VERIFY['scope']} AS scope",
        "s_suppkey % 6 <> 5 AS active",
        "sha2(s_name, 256) AS fingerprint",
        "sha2(concat(s_name, CASE WHEN s_suppkey % 4 = 2 THEN '*' ELSE '' END), 256) AS seen_fingerprint",
        f"{_VERIFY['seen']} AS seen",
    )
    marks = s.filter("seen").select(
        "search_id", F.col("seen_fingerprint").alias("fingerprint"), F.lit("2024-01-01").cast("timestamp").alias("verified_at")
    )
    return s.select("search_id", "scope", "active", "fingerprint"), marks


@query(
    "verification_state",
    """SELECT s_suppkey AS search_id, CASE WHEN s_suppkey % 10 = 0 OR s_suppkey % 4 = 3 THEN 'unverified'
      WHEN s_suppkey % 4 = 2 THEN 'stale' ELSE 'verified' END AS verification FROM supplier""",
)
def verification(t):
    """Searches verified with their current criteria."""
    found, marks = _verified(t)
    return verification_state(found, marks).select("search_id", "verification")


@query(
    "eligible_searches",
    """SELECT s_suppkey AS search_id FROM supplier WHERE s_suppkey % 10 <> 0 AND s_suppkey % 6 <> 5 AND s_suppkey % 4 NOT IN (2, 3)
      AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING sum(CAST(l_returnflag = 'R' AS INT)) * 3 > count(*))""",
)
def eligible(t):
    """Active, targeted, verified searches that are not paused; a pause is many returns."""
    found, marks = _verified(t)
    paused = t.lineitem.groupBy(F.col("l_suppkey").alias("search_id")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count("*").alias("n")
    ).filter("r * 3 > n")
    return eligible_searches(found, marks, paused).select("search_id")


@query(
    "search_order",
    """SELECT s_suppkey AS search_id, CAST(s_suppkey % 5 + 1 AS INT) AS priority,
      row_number() OVER (ORDER BY s_suppkey % 5 + 1, s_acctbal, s_suppkey) AS place FROM supplier""",
)
def ordered_searches(t):
    """Searches by priority, then age, then id, with their place."""
    s = t.supplier.select(
        F.col("s_suppkey").alias("search_id"), (F.col("s_suppkey") % 5 + 1).cast("int").alias("priority"), F.col("s_acctbal").alias("created_at")
    )
    # One list of all searches, ranked by chunks.
    ranked = rank_members(search_order(s).withColumn("_all", F.lit(1)), ["_all"], ["priority", "created_at", "search_id"])
    return ranked.select("search_id", "priority", (F.col("rank") + 1).cast("bigint").alias("place"))


_DRAFT = {
    "name": "CASE WHEN s_suppkey % 17 = 0 THEN '  ' ELSE s_name END",
    "priority": "CASE WHEN s_suppkey % 19 = 0 THEN 0 ELSE s_suppkey % 5 + 1 END",
    "radius_km": "CASE WHEN s_suppkey % 4 = 0 THEN 150 WHEN s_suppkey % 4 = 1 THEN 40 END",
    "location_mode": "CASE WHEN s_suppkey % 4 IN (0, 1) THEN 'radius' WHEN s_suppkey % 4 = 2 THEN 'nationwide' ELSE 'nearby' END",
    "origin": "CASE WHEN s_suppkey % 8 = 0 THEN NULL WHEN s_suppkey % 4 IN (0, 1) THEN 'Lisbon' WHEN s_suppkey % 12 = 2 THEN 'Porto' END",
    "scope": "CASE WHEN s_suppkey % 9 = 0 THEN 'broad' ELSE 'targeted' END",
}


def _drafts(t):
    s = t.supplier.selectExpr("s_suppkey AS search_id", *[f"{e} AS {n}" for n, e in _DRAFT.items()], "true AS active")
    return s.join(M.searches(t), "search_id")


@query(
    "validate_searches",
    f"""WITH s AS (SELECT s_suppkey AS search_id, {", ".join(f"{e} AS {n}" for n, e in _DRAFT.items())},
      {", ".join(f"{e} AS {n}" for n, e in M.SEARCH.items())} FROM supplier),
    issues AS (
      SELECT 'name' AS path, '{R.length(1, 100)}' AS message FROM s WHERE trim(name) = ''
      UNION ALL SELECT 'priority', '{R.whole_number(1, 1000)}' FROM s WHERE priority < 1
      UNION ALL SELECT 'criteria.scope', '{R.any_of("fuels", "price_range", "maximum_mileage", "minimum_year", "required_keywords")}'
        FROM s WHERE scope = 'broad' AND NOT (has_target OR price_hard OR min_year IS NOT NULL OR has_required OR (has_make AND NOT has_target))
      UNION ALL SELECT 'location.origin', '{R.empty_for("nationwide")}' FROM s WHERE location_mode = 'nationwide' AND origin IS NOT NULL
      UNION ALL SELECT 'location.mode', '{R.choice("radius", "nationwide")}' FROM s WHERE location_mode = 'nearby'
      UNION ALL SELECT 'location.origin', '{R.length(1, 160)}' FROM s WHERE location_mode = 'radius' AND origin IS NULL
      UNION ALL SELECT 'location.radius_km', '{R.choice(*RADII)}' FROM s WHERE location_mode = 'radius' AND radius_km = 40
      UNION ALL SELECT 'criteria', '{R.any_of("make_keywords", "model_keywords", "variant_keywords", "required_keywords")}'
        FROM s WHERE scope = 'targeted' AND NOT has_target AND NOT has_required AND NOT has_make)
    SELECT path, message, count(*) AS violations FROM issues GROUP BY ALL""",
)
def check_searches(t):
    """Rules that saved searches break."""
    return issue_counts(validate_searches(_drafts(t), F.lit(2024)))


@query(
    "normalize_searches",
    f"""WITH s AS (SELECT s_suppkey AS search_id, {", ".join(f"{e} AS {n}" for n, e in _DRAFT.items())} FROM supplier)
    SELECT search_id, trim(name) AS name, scope, location_mode,
      CASE WHEN location_mode <> 'nationwide' THEN coalesce(origin, 'Lisbon, Portugal') END AS origin,
      CAST(CASE WHEN location_mode <> 'nationwide' THEN coalesce(radius_km, 150) END AS INT) AS radius_km FROM s""",
)
def tidy_searches(t):
    """Searches with trimmed text and defaults."""
    return normalize_searches(_drafts(t)).select("search_id", "name", "scope", "location_mode", "origin", F.col("radius_km").cast("int").alias("radius_km"))


@query(
    "model_batch",
    """WITH targets AS (SELECT p_partkey // 10 AS batch_id, p_partkey AS position, p_brand AS make, p_type AS model, split_part(p_name, ' ', 1) AS variant,
        CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 100 END AS budget FROM part),
      bad AS (SELECT batch_id FROM (SELECT batch_id, make, model, variant, count(*) AS n FROM targets GROUP BY ALL) GROUP BY batch_id HAVING max(n) > 1)
    SELECT batch_id, position, regexp_replace(lower(make), '[^a-z0-9]', '', 'g') || ':' || lower(model) || ':' || lower(variant) AS target_key,
      coalesce(budget, batch_id * 1000) AS budget, CASE WHEN batch_id IN (SELECT batch_id FROM bad) THEN 'doubled target' END AS rejected FROM targets""",
)
def batches(t):
    """One search per model target; batches with a doubled target are rejected whole."""
    targets = t.part.selectExpr(
        "CAST(floor(p_partkey / 10) AS BIGINT) AS batch_id",
        "p_partkey AS position",
        "p_brand AS make",
        "p_type AS model",
        "split_part(p_name, ' ', 1) AS variant",
        "CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 100 END AS budget",
    )
    shared = targets.select("batch_id").distinct().withColumn("budget", (F.col("batch_id") * 1000).cast("bigint"))
    return model_batch(shared, targets).select("batch_id", "position", "target_key", "budget", "rejected")


@query(
    "model_target_key",
    """SELECT p_partkey AS listing_id, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || ':' || lower(p_type) || ':' ||
      regexp_replace(lower(coalesce(CASE WHEN p_partkey % 4 <> 0 THEN p_name END, '')), '[^a-z0-9]', '', 'g') AS target_key FROM part""",
)
def target_keys(t):
    """Identity of make, model and variant."""
    variant = F.when(F.col("p_partkey") % 4 != 0, F.col("p_name"))
    return t.part.select(
        F.col("p_partkey").alias("listing_id"), model_target_key(F.col("p_brand"), F.col("p_type"), variant).alias("target_key")
    )


_INBOX = """ SELECT l.listing_id, l.title, l.price_cents, r.state FROM flagged l
  JOIN (SELECT p_partkey AS listing_id, CASE WHEN p_partkey % 5 = 0 THEN 'shortlisted' ELSE 'new' END AS state, p_partkey % 13 = 0 AS archived FROM part) r USING (listing_id)
  LEFT JOIN (SELECT p_partkey AS listing_id, CASE WHEN p_partkey % 12 < 7 THEN 'exclude' ELSE 'continue' END AS decision FROM part WHERE p_partkey % 3 <> 0) c USING (listing_id)
  WHERE NOT archived AND coalesce(decision <> 'exclude', true)
    AND EXISTS (SELECT 1 FROM matched m WHERE m.listing_id = l.listing_id AND match_status <> 'excluded' {search}) {more}"""


def _inbox(t):
    base = risk_flags(M.listings(t)).select("listing_id", "title", "last_seen_at")
    facts = M.listings(t).select("listing_id", "make", "model", "price_cents")
    flags = risk_flags(M.listings(t)).select("listing_id", "high_risk")
    reviews = t.part.selectExpr(
        "p_partkey AS listing_id",
        "CASE WHEN p_partkey % 5 = 0 THEN 'shortlisted' ELSE 'new' END AS state",
        "p_partkey % 13 = 0 AS archived",
    )
    classes = t.part.filter("p_partkey % 3 <> 0").selectExpr(
        "p_partkey AS listing_id", "CASE WHEN p_partkey % 12 < 7 THEN 'exclude' ELSE 'continue' END AS decision"
    )
    return inbox_join(base, reviews, facts, flags, classes)


@query("inbox_filter", _MATCHED + _INBOX.format(search="", more=""))
def inbox(t):
    """Visible listings."""
    return inbox_filter(_inbox(t), matches(t)).select("listing_id", "title", "price_cents", "state")


@query(
    "inbox_filter_search",
    _MATCHED
    + _INBOX.format(
        search="AND m.search_id = 3",
        more="AND price_cents <= 1100000 AND state = 'new' AND (contains(lower(title), 'ring') OR contains(lower(make), 'ring') OR contains(lower(model), 'ring'))",
    ),
)
def inbox_search(t):
    """Visible listings of one search under budget that mention a word."""
    kept = inbox_filter(_inbox(t), matches(t), M.links(t), state="new", query=" Ring ", search_id=3, budget_eur=11_000)
    return kept.select("listing_id", "title", "price_cents", "state")


@query(
    "summary_counts",
    _MATCHED
    + """ SELECT count(*) AS total, count(*) FILTER (match_status = 'matches') AS matching, count(*) FILTER (high_risk) AS risky,
      count(*) FILTER (price_cents IS NULL) AS unpriced, count(*) FILTER (match_status = 'needs_information') AS undecided FROM matched""",
)
def counts(t):
    """Dashboard counts."""
    return summary_counts(
        matches(t),
        matching=F.col("match_status") == "matches",
        risky=F.col("high_risk"),
        unpriced=F.col("price_cents").isNull(),
        undecided=F.col("match_status") == "needs_information",
    )


# Corrections of some listings: a price for one in ten, a year for another.
_CORRECTED_SQL = M.LISTINGS_SQL.replace("listings AS (", "original AS (", 1).replace(
    "flagged AS (",
    """listings AS (SELECT * REPLACE (CASE WHEN listing_id % 10 = 1 THEN listing_id * 7000 ELSE price_cents END AS price_cents,
      CASE WHEN listing_id % 10 = 2 THEN 2003 ELSE year END AS year) FROM original),
flagged AS (""",
    1,
)


def _reassessed(t):
    from lotwise.plans.reassess import correct_and_reassess

    def rows(rest, field, value, at):
        return M.listings(t).filter(F.col("listing_id") % 10 == rest).select(
            "listing_id", F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(at).cast("timestamp").alias("created_at"), F.col("listing_id").alias("id")
        )

    earlier = rows(1, "price_cents", F.lit(1), "2024-01-01")
    made = rows(1, "price_cents", F.col("listing_id") * 7000, "2024-02-01").unionByName(rows(2, "year", F.lit(2003), "2024-02-01"))
    scores = M.links(t).select("listing_id", "search_id")
    return correct_and_reassess(M.listings(t), earlier, made, M.links(t), M.searches(t), scores)


@query(
    "correct_and_reassess",
    M.with_sql(_CORRECTED_SQL, M.MATCH_SQL) + " SELECT listing_id, search_id, match_status, price_cents, high_risk FROM matched WHERE listing_id % 10 IN (1, 2)",
)
def reassessed_matches(t):
    """Matches of corrected listings with every search that saw them."""
    return _reassessed(t).matches.select("listing_id", "search_id", "match_status", "price_cents", "high_risk")


@query("reassess_scores", "SELECT DISTINCT l_partkey AS listing_id, l_suppkey AS search_id FROM lineitem WHERE l_partkey % 10 NOT IN (1, 2)")
def reassessed_scores(t):
    """Scores that stay valid after corrections."""
    return _reassessed(t).scores


@query("reassess_requests", "SELECT p_partkey AS listing_id, 'queued' AS state, CAST(0 AS BIGINT) AS attempts FROM part WHERE p_partkey % 10 IN (1, 2)")
def reassessed_requests(t):
    """Corrected listings wait for enrichment again."""
    from lotwise.operators.queues import enrichment_queue

    return enrichment_queue(_reassessed(t).requests).select("listing_id", "state", "attempts")
