"""Queries over the given tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import alignment, bpe, chat, decontaminate, html_text, language, licenses, near_dups, substring, token_files, top_k, url_filter, whitening
from lotwise.session import ensure_checkpoint_dir, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of (spark, folder) and its SQL twin."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: run(prepare(spark), folder)
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A tokenizer's file on the machine that runs the task; only used where none is passed."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_bpe")
def bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(table(spark, folder, "documents"), tokenizer_path())


_CHAT_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
written AS (
  SELECT *, regexp_replace(text, '(</?|\[/?)(\\*)(s>|INST\])', '\1\\\2\3', 'g') AS safe,
    replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '[', '%5B'), '<', '%3C') AS safe_role
  FROM said),
conv AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    string_agg(CASE WHEN role = 'assistant' THEN '<s>' || safe || '</s>'
      ELSE '[INST] ' || safe_role || chr(10) || safe || ' [/INST]' END, '' ORDER BY turn, role, text) AS formatted
  FROM written GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  length(formatted) AS formatted_chars
FROM conv
"""


@query("op4_chat", _CHAT_SQL)
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    control = F.lit("</s>[INST] ok [/INST]")
    fixed = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), control.alias("text")
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    events = rows.select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text")
    return chat.digest_columns(chat.read_back(chat.render(chat.fold_events(events))))


_LEAK_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p))),
hits AS (SELECT doc_id, i, p.n, item_id FROM dw JOIN p ON dw.n = p.n AND dw.s = p.s),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op7_decontamination", _LEAK_SQL)
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("item_ids")


# The rules of the query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_URL_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, u.host, u.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
  coalesce(max_by(r.verdict, length(r.host || r.path)), 'allow') AS verdict
FROM u LEFT JOIN r ON (u.host = r.host OR suffix(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
GROUP BY page_id, u.host, u.path
"""


@query("op10_url_filter", _URL_SQL)
def url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, folder, "pages"), rules)


@query("op1_language")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.train_language_model(docs)
    found = language.predict_language(docs, model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op9_licenses")
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


_TOP_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.x, d.x)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.x) = len(d.x) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10
"""


@query("op5_top_k", _TOP_SQL)
def vector_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k.exact_top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


_PAGE_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS body FROM pages),
b AS (
  SELECT page_id, url, string_split(regexp_replace(regexp_replace(body, '</?(h1|p)>', chr(1), 'g'), '<br>|</?b>', ' ', 'g'), chr(1)) AS blocks FROM a),
c AS (
  SELECT page_id, url, list_filter(list_transform(blocks, lambda x: trim(regexp_replace(
    replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), chr(160), ' '), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM b)
SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text, length(array_to_string(blocks, chr(10) || chr(10))) AS n_chars FROM c
"""


@query("op6_html_text", _PAGE_SQL)
def page_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(table(spark, folder, "pages"))


@query("op8_near_duplicates")
def near_duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.near_duplicate_classes(table(spark, folder, "documents"))


_REPEAT_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS place FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM r WHERE place > 1),
gone AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w
    ELSE list_filter(w, lambda x, i: NOT list_contains(ks, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""


@query("op2_substring_dedup", _REPEAT_SQL)
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.remove_repeats(table(spark, folder, "documents"))


@query("op11_whitening")
def embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"


@query("op13_token_files")
def token_output(spark: SparkSession, folder: str) -> DataFrame:
    out = run_folder(spark, "tokens")
    token_files.write_tokens(table(spark, folder, "documents"), out, tokenizer_path())
    found = token_files.read_documents(spark, out)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op12_token_alignment")
def token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return alignment.link_tokens(table(spark, folder, "documents"), run_folder(spark, "alignment"), *paths)
