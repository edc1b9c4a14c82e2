"""Queries over the synthetic tables, each with SQL that must give the same rows.

The tables stand in for the domain's: documents for events and leads, pages for sources, events for captures, sightings
and receipts, orders for scoped events, part for the catalog, lineitem for score dimensions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions import ids, score, text, timing, udfs
from auditlake.operators import acquisition, alerting, applicability, calibration, common, discovery, evaluation, graph, language, library, linkage, planning, snapshots, validation, worksheet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a query by its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- change chains ---------------------------------------------------------------------------------------------------


def captures(spark: SparkSession, d: str) -> DataFrame:
    """Events as captures of pages (user, type) whose content is the type's value in tens."""
    e = table(spark, d, "events")
    return e.select(
        F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("page_key"), "event_id", F.col("ts").alias("captured_at"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("snapshot_id"), F.floor(F.col("value") / 100).cast("long").alias("content_hash"),
    )


CAPTURES = """captures AS (SELECT user_id::VARCHAR || '/' || event_type AS page_key, event_id, ts AS captured_at,
  lpad(event_id::VARCHAR, 12, '0') AS snapshot_id, floor(value / 100)::BIGINT AS content_hash FROM events)"""
CHAIN = f"""WITH {CAPTURES}, o AS (SELECT *, lag(snapshot_id) OVER w AS p, lag(content_hash) OVER w AS h FROM captures
  WINDOW w AS (PARTITION BY page_key ORDER BY captured_at, snapshot_id)),
chain AS (SELECT page_key, snapshot_id, captured_at, content_hash, p AS previous_snapshot_id,
  CASE WHEN p IS NULL THEN 'first_seen' WHEN h = content_hash THEN 'unchanged' ELSE 'changed' END AS change_status FROM o)"""


@query(CHAIN + " SELECT page_key, snapshot_id, previous_snapshot_id, change_status FROM chain")
def change_chain(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.chain(captures(spark, d)).select("page_key", "snapshot_id", "previous_snapshot_id", "change_status")


@query(CHAIN + " SELECT change_status, count(*) AS n FROM chain GROUP BY ALL")
def change_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.chain(captures(spark, d)).groupBy("change_status").agg(F.count("*").alias("n"))


@query(CHAIN + """, stored AS (SELECT * REPLACE (CASE WHEN event_id % 97 = 0 THEN 'changed' ELSE change_status END AS change_status)
  FROM chain JOIN (SELECT snapshot_id, event_id FROM captures) USING (snapshot_id))
SELECT s.page_key, s.snapshot_id, c.change_status AS expected_status FROM stored s JOIN chain c USING (snapshot_id) WHERE s.change_status <> c.change_status""")
def chain_audit(spark: SparkSession, d: str) -> DataFrame:
    """The audit finds statuses that were overwritten."""
    stored = snapshots.chain(captures(spark, d)).withColumn("change_status", F.when(F.col("event_id") % 97 == 0, "changed").otherwise(F.col("change_status")))
    return snapshots.audit(stored).select("page_key", "snapshot_id", "expected_status")


@query(f"""WITH {CAPTURES} SELECT page_key, snapshot_id, content_hash FROM captures
QUALIFY row_number() OVER (PARTITION BY page_key ORDER BY captured_at DESC, snapshot_id DESC) = 1""")
def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.latest(captures(spark, d)).select("page_key", "snapshot_id", "content_hash")


@query(f"""WITH {CAPTURES}, b AS (SELECT *, max(captured_at) OVER (PARTITION BY page_key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM captures)
SELECT page_key, event_id, top IS NULL OR captured_at >= top AS accepted FROM b""")
def late_capture_policy(spark: SparkSession, d: str) -> DataFrame:
    """What a store that refuses earlier captures takes, in order of arrival."""
    return snapshots.admit(captures(spark, d).withColumn("seq", F.col("event_id")), "sqlite").select("page_key", "event_id", "accepted")


LATE = """late AS (SELECT user_id::VARCHAR AS page_key, event_id, date_trunc('day', ts - INTERVAL 1 HOUR * (event_id * 37 % 100)) AS captured_at,
  lpad(event_id::VARCHAR, 12, '0') AS snapshot_id, event_id % 2 AS content_hash FROM events)"""


def late_captures(spark: SparkSession, d: str) -> DataFrame:
    """Captures of users' pages, to the day, that arrive up to four days late, with two contents."""
    e = table(spark, d, "events")
    back = F.make_dt_interval(hours=(F.col("event_id") * 37 % 100).cast("int"))
    return e.select(
        F.col("user_id").cast("string").alias("page_key"), "event_id", F.date_trunc("day", F.col("ts") - back).alias("captured_at"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("snapshot_id"), (F.col("event_id") % 2).cast("string").alias("content_hash"), F.col("event_id").alias("seq"),
    )


#: Arrivals with the latest time before, and the content that came first with it.
TOPS = f"""WITH {LATE}, b AS (SELECT *, max(captured_at) OVER o AS top FROM late WINDOW o AS (PARTITION BY page_key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT page_key, captured_at AS top, arg_min(content_hash, event_id) AS held FROM late GROUP BY ALL)"""


@query(TOPS + " SELECT page_key, event_id, top IS NULL OR captured_at > top OR (captured_at = top AND content_hash = held) AS accepted FROM b LEFT JOIN h USING (page_key, top)")
def late_capture_git(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.admit(late_captures(spark, d), "git").select("page_key", "event_id", "accepted")


@query(TOPS + " SELECT page_key, event_id, top IS NULL OR captured_at > top OR (captured_at = top AND content_hash = held) AS accepted FROM b LEFT JOIN h USING (page_key, top)")
def late_capture_s3(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.admit(late_captures(spark, d), "s3").select("page_key", "event_id", "accepted")


@query(f"WITH {LATE} SELECT page_key, event_id, true AS accepted FROM late")
def late_capture_filesystem(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.admit(late_captures(spark, d), "filesystem").select("page_key", "event_id", "accepted")


@query(f"""WITH {CAPTURES} SELECT event_id FROM captures c WHERE NOT EXISTS (SELECT 1 FROM captures d WHERE d.content_hash = c.content_hash AND d.page_key < c.page_key)""")
def orphaned_objects(spark: SparkSession, d: str) -> DataFrame:
    """Captures whose content no earlier page has."""
    c = captures(spark, d)
    first = c.groupBy("content_hash").agg(F.min("page_key").alias("first"))
    claimed = c.join(first, "content_hash").filter(F.col("page_key") > F.col("first")).select("event_id")
    return snapshots.orphans(c.select("event_id"), claimed, "event_id")


# -- text, URLs and ids ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ' ') AS normalized, length(array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), '')) AS compact_chars FROM documents")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.normalized(c).alias("normalized"), F.length(text.compact(c)).cast("long").alias("compact_chars"))


URL_PARTS = """u AS (SELECT page_id, trim(url) AS url FROM pages), q AS (SELECT page_id, lower(regexp_extract(url, '^https?://[^/?#]+')) AS head,
  regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS path, regexp_extract(url, '\\?([^#]*)', 1) AS asked FROM u),
k AS (SELECT *, array_to_string(list_sort(list_filter(list_transform(string_split(asked, '&'), lambda p: CASE WHEN p = '' OR contains(p, '=') THEN p ELSE p || '=' END),
  lambda p: p <> '' AND NOT starts_with(lower(regexp_extract(p, '^[^=]*')), 'utm_') AND lower(regexp_extract(p, '^[^=]*')) NOT IN ('from', 'source', 'ref', 'ref_', 'spm', 'scm'))), '&') AS kept FROM q),
c AS (SELECT page_id, head || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical, regexp_extract(head, '://(.*)$', 1) AS host FROM k)"""


@query(f"WITH {URL_PARTS} SELECT page_id, canonical, host FROM c")
def canonical_url_clean(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", text.canonical_url(F.col("url")).alias("canonical"), text.authority(F.col("url")).alias("host"))


@query(f"WITH {URL_PARTS} SELECT canonical, count(*) AS n, min(page_id) AS first_page FROM c GROUP BY canonical HAVING count(*) > 1")
def url_duplicates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical"))
    return p.groupBy("canonical").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).filter("n > 1")


@query("SELECT p_partkey, 'regulation ' || (2000 + p_size) || '/' || p_partkey AS found FROM part")
def regulatory_identifier_extract(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers written into part names are found again, normalised; ``/`` separates words."""
    said = F.concat(F.lit("See Regulation "), (F.col("p_size") + 2000).cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(" on "), "p_name")
    found = F.transform(text.identifiers(said), lambda x: F.regexp_replace(x, r"^regulation ([0-9]+) ([0-9]+)$", "regulation $1/$2"))
    return table(spark, d, "part").select("p_partkey", F.array_join(found, "|").alias("found"))


@query("""SELECT doc_id, array_to_string(list_sort(list_transform(regexp_extract_all(lower(text), '\\d{4}[-/.年]\\d{1,2}(?:[-/.月]\\d{1,2}日?)?|\\b\\d{6,10}\\b|\\d+(?:[.,]\\d+)?\\s*(?:%|％|percent|percentage points?|个百分点|欧元|美元|元|days?|天|日|个月|months?|years?|年)|[一二三四五六七八九十百千万]+(?:欧元|美元|元|天|日|个月|年)'), lambda x: replace(x, ' ', ''))), '|') AS facts,
  array_to_string(list_filter(['allowed','cancelled','exempt','exemption','may not','must','prohibit','prohibited','required','requirement','resumed','suspended','不得','允许','应当','必须','恢复','暂停','禁止','要求','豁免'], lambda t: contains(lower(text), t)), '|') AS obligations FROM documents""")
def fact_signals_extract(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.array_join(text.facts(c), "|").alias("facts"), F.array_join(text.obligations(c), "|").alias("obligations"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END),
  lambda x: NOT regexp_matches(x, '^(19[0-9][0-9]|20[0-9][0-9]|2100)$')))), ' ') AS anchors FROM documents""")
def number_anchors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(text.number_anchors(F.col("text")), " ").alias("anchors"))


@query("""SELECT p_partkey, replace(printf('%04d.%02d', (p_partkey * 37 % 9000 + 1000)::INT, p_size::INT), '.', '') AS code,
  regexp_matches(replace(printf('%04d.%02d', (p_partkey * 37 % 9000 + 1000)::INT, p_size::INT), '.', ''), '^[0-9]{4,10}$') AS valid FROM part""")
def hs_code_normalize(spark: SparkSession, d: str) -> DataFrame:
    said = F.format_string("%04d.%02d", F.col("p_partkey") * 37 % 9000 + 1000, F.col("p_size"))
    code = text.hs_code(said)
    return table(spark, d, "part").select("p_partkey", code.alias("code"), text.valid_hs(code).alias("valid"))


@query("""WITH c AS (SELECT doc_id, CASE WHEN lang LIKE 'en%' THEN 'en' WHEN lang LIKE 'zh%' THEN 'zh' ELSE 'unknown' END AS family,
  len(regexp_extract_all(text, '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]')) AS han, len(regexp_extract_all(text, '[A-Za-z]')) AS latin FROM documents)
SELECT doc_id, family, han, latin, (han + latin >= 20) AND ((family = 'zh' AND latin >= 0.75 * (han + latin) AND han < 8) OR (family = 'en' AND han >= 0.35 * (han + latin) AND han >= 8)) AS mismatch FROM c""")
def script_ratio_language(spark: SparkSession, d: str) -> DataFrame:
    out = language.assess(table(spark, d, "documents"), "text", "lang")
    return out.select("doc_id", "family", F.col("han").cast("long").alias("han"), F.col("latin").cast("long").alias("latin"), "mismatch")


@query("SELECT doc_id, sha256(text) AS content_hash, substr(sha256(text), 1, 20) AS page_key, '20260101000000-' || substr(sha256(text), 1, 12) AS snapshot_id FROM documents")
def content_hash_ids(spark: SparkSession, d: str) -> DataFrame:
    digest = ids.hashed(F.col("text"))
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return table(spark, d, "documents").select("doc_id", digest.alias("content_hash"), ids.page_key(F.col("text")).alias("page_key"), ids.snapshot_id(at, digest).alias("snapshot_id"))


@query(f"WITH {URL_PARTS} SELECT page_id, substr(sha256(canonical || chr(10) || 'claim ' || page_id || chr(10) || '2026-07-01T00:00:00+00:00'), 1, 24) AS lead_id FROM c")
def lead_ids(spark: SparkSession, d: str) -> DataFrame:
    claim = F.concat(F.lit("Claim "), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", ids.lead_id(F.col("url"), claim, F.lit("2026-07-01T00:00:00+00:00")).alias("lead_id"))


@query("""WITH n(r_name, n) AS (SELECT r_name, CASE lower(r_name) WHEN 'us' THEN 'united states' ELSE array_to_string(regexp_extract_all(lower(r_name), '[\\p{L}\\p{N}_]+'), ' ') END FROM region)
SELECT r_name, n AS scope, CASE WHEN n IN ('', 'unknown', 'global', 'not stated', 'n/a', 'none') THEN NULL ELSE n END AS known FROM n""")
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("r_name")
    return table(spark, d, "region").select("r_name", text.canonical_scope(c).alias("scope"), text.known_scope(c).alias("known"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, replace(p_name || '|' || p_type, '|', '\\|') AS cell FROM part")
def slugs_and_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), text.table_cell(F.concat_ws("|", "p_name", "p_type")).alias("cell"))


# -- levels and scores -----------------------------------------------------------------------------------------------

SCORED = "s AS (SELECT *, ((l_linenumber + l_quantity)::BIGINT % 11)::INT AS score FROM lineitem)"
LEVEL = "CASE WHEN score >= 8 THEN 'high' WHEN score >= 5 THEN 'medium' WHEN score >= 2 THEN 'low' ELSE 'watch' END"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("score", ((F.col("l_linenumber") + F.col("l_quantity")).cast("long") % 11).cast("int"))


@query(f"WITH {SCORED} SELECT {LEVEL} AS level, count(*) AS n, min(score) AS low, max(score) AS top FROM s GROUP BY 1")
def level_from_score(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy(score.level_for_score(F.col("score")).alias("level")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("top"))


@query(f"""WITH {SCORED}, b AS (SELECT l_orderkey, l_linenumber, score, {LEVEL} AS ruled, CASE l_linestatus WHEN 'O' THEN 'watch' ELSE {LEVEL} END AS level, l_returnflag = 'R' AS documented FROM s)
SELECT CASE WHEN level = ruled AND documented THEN 'redundant_override' WHEN level <> ruled AND documented THEN 'override' WHEN level <> ruled THEN 'violation' ELSE 'ruled' END AS outcome, count(*) AS n FROM b GROUP BY 1""")
def level_override_rules(spark: SparkSession, d: str) -> DataFrame:
    ruled = score.level_for_score(F.col("score"))
    level, documented = F.when(F.col("l_linestatus") == "O", "watch").otherwise(ruled), F.col("l_returnflag") == "R"
    outcome = F.when((level == ruled) & documented, "redundant_override").when((level != ruled) & documented, "override").when(level != ruled, "violation").otherwise("ruled")
    return scored(spark, d).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS a, l_partkey % 3 AS b, l_suppkey % 4 AS c, l_orderkey % 3 AS d, (l_quantity::BIGINT) % 3 AS e, (l_linenumber + l_quantity)::BIGINT % 11 AS score FROM lineitem)
SELECT count(*) FILTER (c > 2) AS out_of_range, count(*) FILTER (c <= 2 AND a + b + c + d + e <> score) AS wrong_sum, count(*) FILTER (c <= 2 AND a + b + c + d + e = score) AS ok FROM b""")
def score_breakdown_check(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.col("l_linenumber") % 3, F.col("l_partkey") % 3, F.col("l_suppkey") % 4, F.col("l_orderkey") % 3, F.col("l_quantity").cast("long") % 3]
    fits, total = F.forall(F.array(*[p.cast("long") for p in parts]), lambda x: x.between(0, 2)), sum(parts, F.lit(0))
    return scored(spark, d).agg(F.count_if(~fits).alias("out_of_range"), F.count_if(fits & (total != F.col("score"))).alias("wrong_sum"), F.count_if(fits & (total == F.col("score"))).alias("ok"))


@query("""WITH m AS (SELECT max(ts) AS cutoff FROM events), a AS (SELECT event_type, date_diff('microsecond', ts, cutoff) / 3.6e9 AS hours FROM events, m)
SELECT event_type, CASE WHEN hours <= 24 THEN 25 WHEN hours <= 72 THEN 21 WHEN hours <= 168 THEN 16 WHEN hours <= 336 THEN 10 WHEN hours <= 720 THEN 5 ELSE 0 END AS recency, count(*) AS n FROM a GROUP BY ALL""")
def recency_buckets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    cutoff = F.lit(e.agg(F.max("ts")).first()[0])
    return e.groupBy("event_type", score.recency(F.col("ts"), cutoff).alias("recency")).agg(F.count("*").alias("n"))


PRIORITY_SQL = """WITH m AS (SELECT max(ts) AS cutoff FROM events), a AS (SELECT user_id, event_type, value, date_diff('microsecond', ts, cutoff) / 3.6e9 AS hours FROM events, m),
r AS (SELECT user_id, max(CASE WHEN hours <= 24 THEN 25 WHEN hours <= 72 THEN 21 WHEN hours <= 168 THEN 16 WHEN hours <= 336 THEN 10 WHEN hours <= 720 THEN 5 ELSE 0 END) AS recency,
  max(CASE event_type WHEN 'purchase' THEN 20 WHEN 'signup' THEN 16 WHEN 'view' THEN 14 WHEN 'click' THEN 5 ELSE 3 END) AS quality, max(floor(value)::BIGINT % 6) AS momentum, count(DISTINCT event_type) AS domains FROM a GROUP BY user_id),
p AS (SELECT user_id, recency + quality + momentum + CASE WHEN domains >= 4 THEN 30 WHEN domains = 3 THEN 22 WHEN domains = 2 THEN 15 ELSE 0 END AS priority, domains FROM r)
SELECT user_id, priority, domains, priority >= 45 AS qualified, row_number() OVER (ORDER BY priority DESC, domains DESC, user_id) AS rank FROM p"""


@query(PRIORITY_SQL)
def source_tier_priority(spark: SparkSession, d: str) -> DataFrame:
    """Clusters (a user's events) in order of recency, quality, momentum and corroboration."""
    e = table(spark, d, "events")
    cutoff = F.lit(e.agg(F.max("ts")).first()[0])
    tier = F.when(F.col("event_type") == "purchase", "official_lead").when(F.col("event_type") == "signup", "carrier_or_port").when(F.col("event_type") == "view", "trade_media").when(F.col("event_type") == "click", "social").otherwise("other")
    rows = e.groupBy("user_id").agg(F.max(score.recency(F.col("ts"), cutoff)).alias("r"), F.max(score.tier_weight(tier)).alias("q"), F.max(F.floor("value") % 6).alias("m"), F.countDistinct("event_type").alias("domains"))
    rows = rows.withColumn("priority", F.col("r") + F.col("q") + F.col("m") + score.corroboration(F.col("domains")))
    rows = common.placed(rows, F.desc("priority"), F.desc("domains"), F.col("user_id"), name="rank")
    return rows.select("user_id", F.col("priority").cast("long").alias("priority"), "domains", (F.col("priority") >= K.MINIMUM_PRIORITY).alias("qualified"), F.col("rank").cast("long").alias("rank"))


@query("""WITH h AS (SELECT regexp_extract(url, '/(en|fr|de|es)/', 1) AS lang, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages), n AS (SELECT lang, count(DISTINCT host) AS domains FROM h GROUP BY lang)
SELECT lang, domains, CASE WHEN domains >= 4 THEN 30 WHEN domains = 3 THEN 22 WHEN domains = 2 THEN 15 ELSE 0 END AS corroboration FROM n""")
def corroboration_by_domain(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").groupBy(F.regexp_extract("url", "/(en|fr|de|es)/", 1).alias("lang")).agg(F.countDistinct(text.authority(F.col("url"))).alias("domains"))
    return p.withColumn("corroboration", score.corroboration(F.col("domains")))


@query("""WITH t AS (SELECT doc_id, source, list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS w FROM documents),
p AS (SELECT doc_id, w, lag(doc_id) OVER o AS other, lag(w) OVER o AS v FROM t WINDOW o AS (PARTITION BY source ORDER BY doc_id))
SELECT doc_id, other, len(list_intersect(w, v)) AS both, len(list_distinct(list_concat(w, v))) AS either, CASE WHEN len(w) + len(v) > 0 THEN round(len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))), 9) END AS similarity FROM p WHERE other IS NOT NULL""")
def jaccard_products(spark: SparkSession, d: str) -> DataFrame:
    """Word sets of neighbouring documents of a source: ids are paired first, then their sets joined."""
    docs = table(spark, d, "documents")
    own = docs.select("doc_id", F.array_distinct(text.tokens(F.col("text"))).alias("w"))  # words as they are found are normal
    p = common.previous_in(docs, "source", "doc_id").filter("previous is not null").withColumnRenamed("previous", "other")
    p = p.join(own, "doc_id").join(own.withColumnsRenamed({"doc_id": "other", "w": "v"}), "other")
    alike = F.round(score.jaccard(F.col("w"), F.col("v")), 9).alias("similarity")
    both = F.size(F.array_intersect("w", "v"))
    return p.select("doc_id", "other", both.cast("long").alias("both"), (F.size("w") + F.size("v") - both).cast("long").alias("either"), alike)


# -- receipts, coverage and health -----------------------------------------------------------------------------------

RESULTS = ("no_relevant_update", "candidate_found", "verified_event", "login_required", "blocked", "not_applicable")
RECEIPTS = """receipts AS (SELECT user_id AS task_id, event_id AS pos, ts, CASE event_type WHEN 'click' THEN 'no_relevant_update' WHEN 'view' THEN 'candidate_found' WHEN 'purchase' THEN 'verified_event' WHEN 'error' THEN 'blocked' ELSE 'login_required' END AS result,
  CASE WHEN event_type = 'error' AND value < 20 THEN 'SchemaError' WHEN event_type = 'error' AND value < 40 THEN 'TimeoutError' WHEN event_type = 'error' AND value < 60 THEN 'RateLimit' END AS error_type, value, event_type FROM events)"""


def receipts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.col("event_type")
    result = F.when(kind == "click", "no_relevant_update").when(kind == "view", "candidate_found").when(kind == "purchase", "verified_event").when(kind == "error", "blocked").otherwise("login_required")
    error = F.when((kind == "error") & (F.col("value") < 20), "SchemaError").when((kind == "error") & (F.col("value") < 40), "TimeoutError").when((kind == "error") & (F.col("value") < 60), "RateLimit")
    return e.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("pos"), "ts", result.alias("result"), error.alias("error_type"), "value", "event_type")


LATEST = f"WITH {RECEIPTS}, latest AS (SELECT * FROM receipts QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, pos) = 1)"
STATE = """CASE WHEN error_type = 'SchemaError' THEN 'schema_drift' WHEN error_type = 'RateLimit' THEN 'rate_limited' WHEN error_type = 'TimeoutError' THEN 'timeout' WHEN result = 'blocked' THEN 'blocked'
  WHEN result = 'login_required' THEN 'login_required' WHEN result IN ('not_applicable', 'candidate_found') THEN 'partial' WHEN value > 400 THEN 'partial' WHEN result = 'no_relevant_update' THEN 'no_relevant_update' ELSE 'ok' END"""


def states(rows: DataFrame) -> DataFrame:
    none = F.lit(None)
    state = acquisition.audit_state(F.col("error_type"), none.cast("int"), F.col("result"), F.col("value") > 400, F.lit(False), F.lit("dashboard"), F.lit(True))
    return rows.withColumn("audit_state", state)


@query(LATEST + " SELECT task_id, pos, result FROM latest")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return common.latest(receipts(spark, d), ["task_id"], "ts", "pos").select("task_id", "pos", "result")


@query(LATEST + f" SELECT task_id, {STATE} AS audit_state FROM latest")
def receipt_state_ladder(spark: SparkSession, d: str) -> DataFrame:
    return states(common.latest(receipts(spark, d), ["task_id"], "ts", "pos")).select("task_id", "audit_state")


@query(LATEST + f""", n AS (SELECT {STATE} AS audit_state, count(*) AS n FROM latest GROUP BY 1)
SELECT s.audit_state, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest({list(K.HEALTH_STATES)}) AS audit_state) s LEFT JOIN n USING (audit_state)""")
def source_health_states(spark: SparkSession, d: str) -> DataFrame:
    rows = states(common.latest(receipts(spark, d), ["task_id"], "ts", "pos")).groupBy("audit_state").agg(F.count("*").alias("n"))
    return common.zero_filled(rows, "audit_state", K.HEALTH_STATES)


@query(LATEST + f""", s AS (SELECT {STATE} AS audit_state FROM latest) SELECT CASE WHEN bool_or(audit_state IN ('blocked','login_required','timeout','rate_limited','schema_drift')) THEN 'degraded'
  WHEN bool_or(audit_state IN ('partial','not_checked','not_configured')) THEN 'incomplete' ELSE 'healthy' END AS overall, count(*) FILTER (audit_state = 'ok') AS ok FROM s""")
def source_health_overall(spark: SparkSession, d: str) -> DataFrame:
    rows = states(common.latest(receipts(spark, d), ["task_id"], "ts", "pos"))
    return acquisition.health_summary(rows).select("overall", F.col("counts")["ok"].alias("ok"))


@query(f"""WITH {RECEIPTS} SELECT task_id, CASE WHEN bool_or(value > 300 AND result IN ('no_relevant_update','candidate_found','verified_event')) THEN 'checked_authenticated' WHEN bool_or(result = 'login_required') THEN 'login_required'
  WHEN bool_or(result = 'blocked') THEN 'blocked' WHEN bool_or(result IN ('no_relevant_update','candidate_found','verified_event','not_applicable')) THEN 'public_checked' ELSE 'not_checked' END AS access_result,
  bool_or(event_type = 'view') AS public_update_checked, max(ts) AS checked_at FROM receipts GROUP BY task_id""")
def coverage_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = receipts(spark, d).withColumn("retrieval_method", F.when(F.col("value") > 300, "browser_authenticated").otherwise("http"))
    return rows.groupBy("task_id").agg(acquisition.access_result().alias("access_result"), F.bool_or(F.col("event_type") == "view").alias("public_update_checked"), F.max("ts").alias("checked_at"))


@query(f"""WITH {RECEIPTS}, m AS (SELECT max(ts) AS now FROM receipts) SELECT pos, task_id FROM receipts, m WHERE result IN ('no_relevant_update','candidate_found','verified_event')
  AND date_diff('second', ts, now) BETWEEN 0 AND 604800 AND ts >= now - INTERVAL 604800 SECOND""")
def ttl_reuse(spark: SparkSession, d: str) -> DataFrame:
    rows = receipts(spark, d)
    now = F.lit(rows.agg(F.max("ts")).first()[0])
    return rows.filter(F.col("result").isin(*K.POSITIVE_RESULTS) & timing.reusable(timing.seconds_between(F.col("ts"), now), 604_800)).select("pos", "task_id")


@query("""WITH r AS (SELECT n_name AS platform, CASE s_suppkey % 3 WHEN 0 THEN 'official_updates' WHEN 1 THEN 'current_policy' ELSE 'dashboard' END AS t, s_acctbal > 0 AS verified, s_suppkey % 2 = 0 AS public FROM supplier JOIN nation ON s_nationkey = n_nationkey),
a AS (SELECT platform, count(DISTINCT t) AS types, bool_and(verified) AS all_ok, count(*) FILTER (verified AND public) AS pub, count(*) FILTER (NOT verified) AS cond FROM r GROUP BY platform),
d AS (SELECT *, CASE WHEN types >= 3 AND all_ok AND pub >= 1 THEN 'full' WHEN types >= 2 THEN 'hybrid' ELSE 'constrained' END AS depth FROM a)
SELECT platform, depth, cond AS conditional, least(100, CASE depth WHEN 'full' THEN 0 WHEN 'hybrid' THEN 40 ELSE 70 END + 20 * (3 - types) + 10 * cond + CASE WHEN pub = 0 THEN 15 ELSE 0 END)::BIGINT AS priority FROM d""")
def dashboard_priority(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("s_suppkey") % 3 == 0, "official_updates").when(F.col("s_suppkey") % 3 == 1, "current_policy").otherwise("dashboard")
    routes = s.select(F.col("n_name").alias("platform"), kind.alias("source_type"), F.when(F.col("s_acctbal") > 0, "verified").otherwise("conditional").alias("verification_status"), F.when(F.col("s_suppkey") % 2 == 0, "public").otherwise("login").alias("access"), F.lit(None).cast("string").alias("last_verified_on"))
    none = spark.createDataFrame([], "platform string, audit_state string, checked_at string")
    return acquisition.dashboard(routes, none).select("platform", "depth", "conditional", F.col("priority").cast("long").alias("priority"))


# -- library ---------------------------------------------------------------------------------------------------------


def sightings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    return e.select(F.col("user_id").cast("string").alias("event_id"), day.alias("report_date"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("cutoff"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("report_key"))


SEEN = "s AS (SELECT user_id::VARCHAR AS event_id, strftime(ts, '%Y-%m-%d') AS report_date, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS cutoff, lpad(event_id::VARCHAR, 12, '0') AS report_key FROM events)"


@query(f"""WITH {SEEN} SELECT event_id, arg_min(report_date, (cutoff, report_date, report_key)) AS first_seen, arg_max(report_date, (cutoff, report_date, report_key)) AS last_seen, count(*) AS sighting_count,
  arg_max(report_key, (cutoff, report_date, report_key)) AS latest_report_key FROM s GROUP BY event_id""")
def sightings_history(spark: SparkSession, d: str) -> DataFrame:
    return library.history(sightings(spark, d))


@query(f"WITH {SEEN} SELECT count(DISTINCT report_key) AS reports, count(*) AS sightings, count(DISTINCT event_id) AS events, min(report_date) AS first_report, max(report_date) AS last_report FROM s")
def library_stats(spark: SparkSession, d: str) -> DataFrame:
    return library.stats(sightings(spark, d))


@query("""WITH m AS (SELECT doc_id, source, lang FROM documents WHERE lower(text) LIKE '%the_h%' OR lower(source) LIKE '%the_h%') SELECT doc_id, source, lang FROM m ORDER BY doc_id LIMIT 50""")
def library_search_like(spark: SparkSession, d: str) -> DataFrame:
    """Containment with a live wildcard, at most 50 hits."""
    docs = table(spark, d, "documents")
    return docs.filter(text.like_any([F.col("text"), F.col("source")], "the_h")).orderBy("doc_id").limit(50).select("doc_id", "source", "lang")


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents) SELECT doc_id FROM t WHERE len(list_filter(w, lambda x: starts_with(x, 'reth') OR starts_with(x, 'ciónr'))) > 0""")
def library_search_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(text.prefix_match(F.col("text"), "Reth ciónr")).select("doc_id")


@query("""SELECT doc_id::VARCHAR AS event_id, '2026-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS last_seen FROM documents WHERE contains(lower(text), 'onthe') OR contains(lower(lang), 'onthe') ORDER BY CASE WHEN len(list_filter(regexp_extract_all(lower(lang || ' ' || text), '[\\p{L}\\p{N}_]+'), lambda x: starts_with(x, 'onthe'))) > 0 THEN 0 ELSE 1 END, doc_id::VARCHAR LIMIT 20""")
def library_search(spark: SparkSession, d: str) -> DataFrame:
    """Word prefixes first, then containment, cut to 20 before the order of the result."""
    docs = table(spark, d, "documents")
    day = F.concat(F.lit("2026-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    rows = docs.select(F.col("doc_id").cast("string").alias("event_id"), day.alias("report_date"), day.alias("cutoff"), day.alias("report_key"), F.col("lang").alias("title"), F.col("text").alias("summary"))
    return library.search(rows, "onthe", 20).select("event_id", "last_seen")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey)""")
def upsert_latest_report(spark: SparkSession, d: str) -> DataFrame:
    """Orders as versions of a customer's report: the last replaces the earlier."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("report_key"), F.col("o_orderkey").alias("ingested_at"), "o_orderstatus")
    half = F.col("ingested_at") % 2 == 0
    stored = library.upsert(rows.limit(0), rows.filter(half))
    both = library.upsert(stored, rows.filter(~half).unionByName(stored))
    return both.unionByName(stored.join(both.select("report_key"), "report_key", "left_anti")).select(F.col("report_key").alias("o_custkey"), F.col("ingested_at").alias("o_orderkey"), "o_orderstatus")


# -- applicability and alerts ----------------------------------------------------------------------------------------


def scoped_events(spark: SparkSession, d: str) -> DataFrame:
    """Orders as events with their customer's nation as jurisdiction."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    none = F.lit("")
    return rows.select(
        F.col("o_orderkey").alias("event_id"), F.col("n_name").alias("jurisdiction"), none.alias("platform"), F.concat_ws(" ", F.lit("HS code"), (F.col("o_orderkey") % 9000 + 1000).cast("string")).alias("title"),
        F.col("c_mktsegment").alias("summary"), none.alias("impact"), none.alias("rationale"), F.array().cast("array<string>").alias("products"), F.array().cast("array<string>").alias("hs_codes"),
    )


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """Parts as catalog items: a market for most, none (any) for some."""
    p = table(spark, d, "part")
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    none = F.array().cast("array<string>")
    rows = p.withColumn("k", F.col("p_partkey") % 25).join(F.broadcast(n), "k")
    return rows.select(
        F.col("p_partkey").cast("string").alias("sku"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 10 == 0, none).otherwise(F.array("n_name")).alias("markets"), none.alias("platforms"),
        F.array((F.col("p_partkey") * 7 % 90 + 10).cast("string")).alias("hs_codes"), F.array(F.when(F.col("p_partkey") % 3 == 0, "BUILDING").otherwise("zz")).alias("keywords"),
    )


MATCHES = """e AS (SELECT o_orderkey AS event_id, lower(n_name) AS j, (o_orderkey % 9000 + 1000)::VARCHAR AS code, lower('HS code ' || (o_orderkey % 9000 + 1000) || ' ' || c_mktsegment) AS body
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
i AS (SELECT p_partkey::VARCHAR AS sku, lower(p_name) AS name, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE lower(n_name) END AS market, (p_partkey * 7 % 90 + 10)::VARCHAR AS hs, CASE WHEN p_partkey % 3 = 0 THEN 'building' ELSE 'zz' END AS word
  FROM part JOIN nation ON p_partkey % 25 = n_nationkey),
m AS (SELECT event_id, sku, starts_with(code, hs) AS by_hs, (length(word) >= 3 AND contains(body, word)) OR (length(name) >= 3 AND contains(body, name)) AS by_term FROM e JOIN i ON market IS NULL OR market = j)"""


@query(f"WITH {MATCHES} SELECT event_id, count(*) AS in_scope, count(*) FILTER (by_hs) AS by_hs, count(*) FILTER (by_term) AS by_term FROM m GROUP BY event_id")
def scope_join_catalog(spark: SparkSession, d: str) -> DataFrame:
    found = applicability.counts(scoped_events(spark, d), catalog(spark, d))
    return found.filter("in_scope > 0").select("event_id", "in_scope", "by_hs", "by_term")


@query(f"WITH {MATCHES} SELECT e.event_id, CASE WHEN count(*) FILTER (by_hs OR by_term) > 0 THEN 'matched' WHEN count(sku) > 0 THEN 'needs_review' ELSE 'no_match' END AS status, count(*) FILTER (by_hs OR by_term) AS n FROM e LEFT JOIN m USING (event_id) GROUP BY e.event_id")
def applicability_status(spark: SparkSession, d: str) -> DataFrame:
    found = applicability.counts(scoped_events(spark, d), catalog(spark, d))
    return found.select("event_id", applicability.status_of(F.col("matched"), F.col("in_scope")).alias("status"), F.col("matched").alias("n"))


@query("""WITH a AS (SELECT p_partkey, (p_partkey * 37 % 9000 + 1000)::VARCHAR AS x FROM part), b AS (SELECT DISTINCT (l_partkey % 900 + 100)::VARCHAR AS y FROM lineitem)
SELECT p_partkey, x, y FROM a JOIN b ON starts_with(x, y) OR starts_with(y, x)""")
def hs_prefix_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Codes of which one begins the other; all prefixes of the longer meet by key."""
    a = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 37 % 9000 + 1000).cast("string").alias("x"))
    b = table(spark, d, "lineitem").select((F.col("l_partkey") % 900 + 100).cast("string").alias("y")).distinct()
    short = a.withColumn("y", F.explode(F.transform(F.sequence(F.lit(1), F.length("x")), lambda n: F.substring(F.col("x"), F.lit(1), n))))
    return short.join(b, "y").select("p_partkey", "x", "y")


def alert_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("points", F.floor(F.col("value")).cast("long") % 11)
    return e.select(
        "event_id", F.when(F.col("event_type") == "error", "unconfirmed").otherwise("new").alias("status"), (F.col("user_id") % 3).alias("evidence"), score.level_for_score(F.col("points")).alias("level"),
        F.when(F.col("user_id") % 5 == 0, "no_match").otherwise("matched").alias("applicability"), ids.hashed(F.concat_ws("|", F.col("user_id").cast("string"), "event_type")).alias("signature"), "ts",
    )


@query("""WITH a AS (SELECT event_id, event_type, user_id, floor(value)::BIGINT % 11 AS score, sha256(user_id::VARCHAR || '|' || event_type) AS signature FROM events),
seen AS (SELECT DISTINCT signature FROM a WHERE event_id % 4 = 0)
SELECT event_id, CASE WHEN event_type = 'error' OR user_id % 3 < 1 THEN 'not_verified' WHEN score < 5 THEN 'below_level' WHEN user_id % 5 = 0 THEN 'not_applicable' WHEN seen.signature IS NOT NULL THEN 'already_alerted' END AS reason FROM a LEFT JOIN seen USING (signature)""")
def alert_cascade(spark: SparkSession, d: str) -> DataFrame:
    rows = alert_rows(spark, d)
    state = rows.filter(F.col("event_id") % 4 == 0).select("signature")
    return alerting.judge(rows, state, "medium", require_match=True).select("event_id", "reason")


@query("""WITH a AS (SELECT event_id, event_type, user_id, floor(value)::BIGINT % 11 AS score, sha256(user_id::VARCHAR || '|' || event_type) AS signature FROM events),
seen AS (SELECT DISTINCT signature FROM a WHERE event_id % 4 = 0)
SELECT signature FROM seen UNION SELECT signature FROM a WHERE event_type <> 'error' AND user_id % 3 >= 1 AND score >= 8 AND signature NOT IN (SELECT signature FROM seen)""")
def alert_state_update(spark: SparkSession, d: str) -> DataFrame:
    rows = alert_rows(spark, d)
    state = rows.filter(F.col("event_id") % 4 == 0).select("signature").distinct()
    return alerting.next_state(state, alerting.judge(rows, state, "high"))


# -- evaluation and calibration --------------------------------------------------------------------------------------


def predictions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents of over 600 characters as predicted events, labels as reviews, in four runs."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    url = lambda c: F.concat(F.lit("https://x.org/"), c.cast("string"))
    run = (F.col("doc_id") % 4).cast("string")
    date = lambda m: F.concat(F.lit("2026-01-"), F.lpad((F.col("doc_id") % m + 1).cast("string"), 2, "0"))
    p = docs.filter("n_chars > 600").select(run.alias("run"), F.col("doc_id").alias("event_id"), url(F.col("n_chars") % 3).alias("source_url"), date(5).alias("published_date"), date(6).alias("effective_date"), date(7).alias("deadline"), F.lit("new").alias("status"), score.level_for_score(F.col("n_chars") % 11).alias("level"))
    g = labels.select(run.alias("run"), F.col("doc_id").alias("event_id"), (F.col("quality") == 1).alias("should_include"), F.array(url(F.lit(0)), url(F.lit(1))).alias("accepted"), date(5).alias("published_date"), date(6).alias("effective_date"), date(8).alias("deadline"), F.when(F.col("toxic") == 1, "ongoing").otherwise("new").alias("status"), score.level_for_score(F.col("doc_id") % 11).alias("level"))
    return p, g


EVAL = """p AS (SELECT (doc_id % 4)::VARCHAR AS run, doc_id, n_chars % 3 < 2 AS src, n_chars % 11 AS ps FROM documents WHERE n_chars > 600),
g AS (SELECT (doc_id % 4)::VARCHAR AS run, doc_id, toxic, doc_id % 11 AS gs FROM labels WHERE quality = 1),
j AS (SELECT coalesce(p.run, g.run) AS run, p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL AS tp, p.doc_id IS NOT NULL AND g.doc_id IS NULL AS fp, p.doc_id IS NULL AS fn, src, toxic,
  (coalesce(p.doc_id, g.doc_id) % 7 = coalesce(p.doc_id, g.doc_id) % 8)::INT AS third, lv(ps) = lv(gs) AS level_ok FROM p FULL JOIN g ON p.doc_id = g.doc_id)""".replace("lv(ps)", "CASE WHEN ps >= 8 THEN 3 WHEN ps >= 5 THEN 2 WHEN ps >= 2 THEN 1 ELSE 0 END").replace("lv(gs)", "CASE WHEN gs >= 8 THEN 3 WHEN gs >= 5 THEN 2 WHEN gs >= 2 THEN 1 ELSE 0 END")


@query(f"""WITH {EVAL}, t AS (SELECT count(*) FILTER (tp) AS tp, count(*) FILTER (fp) AS fp, count(*) FILTER (fn) AS fn FROM j)
SELECT tp, fp, fn, round(tp / (tp + fp), 4) AS "precision", round(tp / (tp + fn), 4) AS recall FROM t""")
def eval_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    p, g = predictions(spark, d)
    return evaluation.metrics(evaluation.sums(evaluation.matched(p, g))).select("tp", "fp", "fn", "precision", "recall")


@query(f"""WITH {EVAL} SELECT count(*) FILTER (tp AND src) AS source_ok, sum(CASE WHEN tp THEN 2 + third ELSE 0 END)::BIGINT AS dates_ok, count(*) FILTER (tp AND toxic = 0) AS status_ok, count(*) FILTER (tp AND level_ok) AS level_ok,
  count(*) FILTER (fp OR (tp AND NOT src)) AS unsupported_sources FROM j""")
def eval_field_accuracy(spark: SparkSession, d: str) -> DataFrame:
    p, g = predictions(spark, d)
    return evaluation.sums(evaluation.matched(p, g)).select("source_ok", "dates_ok", "status_ok", "level_ok", "unsupported_sources")


@query(f"""WITH {EVAL}, e AS (SELECT run, id, unnest([CASE WHEN fp THEN 'false_positive' END, CASE WHEN fn THEN 'false_negative' END, CASE WHEN fp OR (tp AND NOT src) THEN 'unsupported_source' END]) AS kind
  FROM (SELECT j.*, coalesce(d, l)::VARCHAR AS id FROM (SELECT coalesce(p.run, g.run) AS run, p.doc_id AS d, g.doc_id AS l, p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL AS tp, g.doc_id IS NULL AS fp, p.doc_id IS NULL AS fn, src FROM p FULL JOIN g ON p.doc_id = g.doc_id) j))
SELECT run, kind, id FROM e WHERE kind IS NOT NULL""")
def evaluation_error_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every error of every run as a row."""
    p, g = predictions(spark, d)
    return evaluation.errors(evaluation.matched(p, g))


@query(f"WITH {EVAL} SELECT run, count(*) FILTER (tp) AS tp, count(*) FILTER (fp) AS fp, count(*) FILTER (fn) AS fn FROM j GROUP BY ROLLUP (run)")
def eval_history_rollup(spark: SparkSession, d: str) -> DataFrame:
    p, g = predictions(spark, d)
    return evaluation.sums(evaluation.matched(p, g), by_run=True).select("run", "tp", "fp", "fn")


@query(f"""WITH {EVAL}, t AS (SELECT count(*) FILTER (tp) AS tp, count(*) FILTER (fp) AS fp, count(*) FILTER (fn) AS fn, count(*) FILTER (tp AND src) AS s, sum(CASE WHEN tp THEN 2 + third ELSE 0 END) AS dt, count(*) FILTER (fp OR (tp AND NOT src)) AS u FROM j)
SELECT tp + fn >= 20 AS enough, round(tp / (tp + fp), 4) >= 0.9 AS precise, round(tp / (tp + fn), 4) >= 0.9 AS recalled, round(s / tp, 4) >= 0.95 AS sourced, round(dt / (3 * tp), 4) >= 0.98 AS dated, u <= 0 AS supported, false AS passed FROM t""")
def eval_gates(spark: SparkSession, d: str) -> DataFrame:
    """All gates; without deduplication cases their gate fails."""
    p, g = predictions(spark, d)
    none = spark.createDataFrame([], "run string, current_id long, previous_id long, expected_disposition string")
    found = spark.createDataFrame([], "run string, current_id long, previous_id long, disposition string, pos long")
    out = evaluation.evaluate(p, g, none, found, reviewed=True)
    c = "checks."
    return out.select(F.col(c + "minimum_positive_events").alias("enough"), F.col(c + "precision").alias("precise"), F.col(c + "recall").alias("recalled"), F.col(c + "primary_source_rate").alias("sourced"), F.col(c + "date_accuracy").alias("dated"), F.col(c + "unsupported_sources").alias("supported"), "passed")


@query("""WITH m AS (SELECT doc_id % 100 AS current_id, doc_id AS pos, doc_id % 7 AS previous_id, CASE WHEN n_chars > 1000 THEN 'material_update' ELSE 'duplicate_removed' END AS disposition FROM documents),
l AS (SELECT current_id, previous_id, disposition FROM m QUALIFY row_number() OVER (PARTITION BY current_id ORDER BY pos DESC) = 1)
SELECT n AS current_id, coalesce(l.previous_id = n % 7 AND l.disposition = 'material_update', false) AS correct FROM range(120) t(n) LEFT JOIN l ON l.current_id = n""")
def dedup_case_accuracy(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = docs.select(F.lit("r").alias("run"), (F.col("doc_id") % 100).alias("current_id"), F.col("doc_id").alias("pos"), (F.col("doc_id") % 7).alias("previous_id"), F.when(F.col("n_chars") > 1000, "material_update").otherwise("duplicate_removed").alias("disposition"))
    cases = spark.range(120).select(F.lit("r").alias("run"), F.col("id").alias("current_id"), (F.col("id") % 7).alias("previous_id"), F.lit("material_update").alias("expected_disposition"))
    return evaluation.case_outcomes(cases, found).select("current_id", "correct")


@query("""SELECT doc_id AS event_id, 'candidate' AS origin, n_chars > 600 AS should_include FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 'final_only', true FROM documents WHERE doc_id % 2 = 1 AND n_chars > 600""")
def label_scaffold(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    c = docs.select(F.col("doc_id").alias("event_id"), F.col("lang").alias("jurisdiction"), F.col("source").alias("authority"), "n_chars", *[F.lit("").alias(x) for x in ("title", "source_title", "source_url")])
    return evaluation.scaffold(c.filter(F.col("event_id") % 2 == 0), c.filter("n_chars > 600")).select("event_id", "origin", "should_include")


REVIEWS = "r AS (SELECT l_orderkey AS event_id, l_linenumber AS reviewer, CASE (l_quantity::BIGINT + l_linenumber // 3) % 4 WHEN 0 THEN 'watch' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS level, (l_orderkey % 11)::INT AS score FROM lineitem)"
RANKED = REVIEWS.replace("AS score FROM", "AS score, ((l_quantity::BIGINT + l_linenumber // 3) % 4) AS rank FROM")


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as reviews of it."""
    li = table(spark, d, "lineitem")
    rank = (F.col("l_quantity").cast("long") + F.expr("l_linenumber div 3")) % 4
    level = F.when(rank == 0, "watch").when(rank == 1, "low").when(rank == 2, "medium").otherwise("high")
    return li.select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("reviewer"), level.alias("level"), (F.col("l_orderkey") % 11).cast("int").alias("score"))


CONSENSUS = f"""WITH {REVIEWS}, v AS (SELECT event_id, level, count(*) AS n, min(score) AS score FROM r GROUP BY ALL), w AS (SELECT *, max(n) OVER (PARTITION BY event_id) AS top FROM v),
c AS (SELECT event_id, CASE WHEN count(*) FILTER (n = top) = 1 THEN min(level) FILTER (n = top) END AS level, min(score) AS score, sum(n)::BIGINT AS n FROM w GROUP BY event_id)"""


@query(CONSENSUS + " SELECT event_id, level, n FROM c")
def consensus_mode(spark: SparkSession, d: str) -> DataFrame:
    return calibration.consensus(reviews(spark, d)).select("event_id", "level", "n")


@query(f"""WITH {RANKED}, k AS (SELECT *, row_number() OVER (PARTITION BY event_id) AS place FROM r)
SELECT count(*) AS pairs, count(*) FILTER (a.level = b.level) AS exact, sum(3 - abs(a.rank - b.rank))::BIGINT AS thirds FROM k a JOIN k b ON a.event_id = b.event_id AND a.place < b.place""")
def reviewer_agreement(spark: SparkSession, d: str) -> DataFrame:
    return calibration.pair_agreement(reviews(spark, d)).select("pairs", "exact", F.col("thirds").cast("long").alias("thirds"))


LV = "CASE WHEN score <= 1 THEN 'watch' WHEN score <= 4 THEN 'low' WHEN score <= 7 THEN 'medium' ELSE 'high' END"


@query(CONSENSUS + f""", x AS (SELECT level AS actual, {LV} AS predicted, count(*) AS n FROM c WHERE level IS NOT NULL GROUP BY ALL), l AS (SELECT unnest(['watch','low','medium','high']) AS k)
SELECT a.k AS actual, b.k AS predicted, coalesce(n, 0)::BIGINT AS n FROM l a CROSS JOIN l b LEFT JOIN x ON x.actual = a.k AND x.predicted = b.k""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    hist = calibration.histogram(calibration.consensus(reviews(spark, d)))
    w, low, m = (F.lit(x) for x in K.THRESHOLDS)
    return calibration.confusion(hist, score.level_with_thresholds(F.col("score"), w, low, m)).select("actual", "predicted", F.col("n").cast("long").alias("n"))


@query(CONSENSUS + """, t AS (SELECT w.i::INT AS watch, l.i::INT AS low, m.i::INT AS medium FROM range(10) w(i), range(10) l(i), range(10) m(i) WHERE w.i < l.i AND l.i < m.i),
h AS (SELECT score, level, count(*) AS n FROM c WHERE level IS NOT NULL GROUP BY ALL),
p AS (SELECT watch, low, medium, level, n, CASE WHEN score <= watch THEN 'watch' WHEN score <= low THEN 'low' WHEN score <= medium THEN 'medium' ELSE 'high' END AS predicted FROM t, h)
SELECT watch, low, medium, sum(n)::BIGINT AS total, sum(CASE WHEN level = predicted THEN n ELSE 0 END)::BIGINT AS correct FROM p GROUP BY ALL""")
def threshold_grid_search(spark: SparkSession, d: str) -> DataFrame:
    """All 120 triples from a histogram of at most 44 rows."""
    hist = calibration.histogram(calibration.consensus(reviews(spark, d)))
    return calibration.grid_search(hist).select("watch", "low", "medium", F.col("total").cast("long").alias("total"), F.col("correct").cast("long").alias("correct"))


@query(CONSENSUS + f""", k AS (SELECT level, {LV} AS predicted, n FROM c), l AS (SELECT level, count(*) AS m FROM k WHERE level IS NOT NULL GROUP BY level)
SELECT count(level) AS consensus_event_count, count(*) FILTER (level IS NULL) AS excluded_conflict_count, sum(n)::BIGINT AS review_record_count, count(*) FILTER (level <> predicted) AS current_disagreement_count,
(SELECT sum(m) >= 20 AND count(*) = 4 AND min(m) >= 3 FROM l) AS sufficient FROM k""")
def calibration_report(spark: SparkSession, d: str) -> DataFrame:
    out = calibration.calibrate(reviews(spark, d))
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("consensus_event_count", "excluded_conflict_count", "review_record_count", "current_disagreement_count")], "sufficient")


@query("""SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(n_name) IN ('asia', 'france') OR lower(r_name) IN ('asia', 'france')""")
def sources_for_regions(spark: SparkSession, d: str) -> DataFrame:
    """Nations as official sources that also answer to their region's name."""
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.array("r_name").alias("aliases"))
    rows = table(spark, d, "nation").join(region, "n_regionkey").withColumn("jurisdiction", F.col("n_name"))
    return planning.for_regions(rows, ["Asia ", "France"]).select("n_nationkey", "n_name")


@query("""WITH u AS (SELECT CASE WHEN l_linenumber >= 5 THEN 'high' ELSE 'low' END AS level, unnest([['urgency', (l_partkey % 3)::VARCHAR], ['evidence', (l_suppkey % 3)::VARCHAR]]) AS x FROM lineitem)
SELECT level, x[1] AS dimension, sum(x[2]::BIGINT)::BIGINT AS total, count(*) AS n FROM u GROUP BY ALL""")
def dimension_sums(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    rows = li.select(F.when(F.col("l_linenumber") >= 5, "high").otherwise("low").alias("level"), (F.col("l_partkey") % 3).alias("urgency"), (F.col("l_suppkey") % 3).alias("evidence"))
    return rows.unpivot(["level"], ["urgency", "evidence"], "dimension", "value").groupBy("level", "dimension").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


@query("""WITH u AS (SELECT CASE WHEN l_linenumber >= 5 THEN 'high' ELSE 'low' END AS level, l_partkey % 3 AS v FROM lineitem) SELECT level, 'urgency' AS dimension, round(sum(v) / count(*), 3) AS mean FROM u GROUP BY level""")
def dimension_means(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") >= 5, "high").otherwise("low").alias("level"), (F.col("l_partkey") % 3).alias("urgency"))
    return calibration.dimension_means(rows, ("urgency",))


@query("""WITH l AS (SELECT user_id AS event_id, CASE WHEN value >= 300 THEN 'high' WHEN value >= 100 THEN 'medium' ELSE 'low' END AS level FROM events)
SELECT event_id, count(DISTINCT level) AS levels, array_to_string(list_sort(list_distinct(list(level))), ',') AS seen FROM l GROUP BY event_id HAVING count(DISTINCT level) > 1""")
def level_conflicts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("event_id"), F.when(F.col("value") >= 300, "high").when(F.col("value") >= 100, "medium").otherwise("low").alias("level"))
    return worksheet.level_conflicts(e).select("event_id", "levels", F.array_join("seen", ",").alias("seen"))


@query("""WITH f AS (SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS known, o_orderkey % 12 = 0 AS changed FROM orders)
SELECT CASE WHEN NOT known THEN 'new_unscored' WHEN changed THEN 'evidence_changed_requires_review' ELSE 'preserved_complete' END AS merge_status, count(*) AS n FROM f GROUP BY 1
UNION ALL SELECT 'retained_existing_only', count(*) FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AND false HAVING count(*) > 0""")
def worksheet_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("event_id"), F.array().cast("array<string>").alias("semantic_aliases"), F.lit("high").alias("reviewed_level"))
    blank = F.struct(*[F.lit(None).cast("int").alias(x) for x in K.BREAKDOWN]).alias("score_breakdown")
    full = F.struct(*[F.lit(1).alias(x) for x in K.BREAKDOWN]).alias("score_breakdown")
    fresh = o.select("*", blank, F.lit(None).cast("int").alias("score"), ids.hashed(F.col("event_id")).alias("review_fingerprint"))
    old = o.filter(F.col("pos") % 3 == 0).select("*", full, F.lit(5).alias("score"), F.when(F.col("pos") % 12 == 0, "x").otherwise(ids.hashed(F.col("event_id"))).alias("review_fingerprint"))
    return worksheet.merge(fresh, old).groupBy("merge_status").agg(F.count("*").alias("n"))


# -- order, violations, joins ----------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY CASE left(o_orderpriority, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 ELSE 3 END, floor(o_totalprice)::BIGINT % 11 DESC, CASE WHEN o_orderstatus = 'P' THEN '9999-99-99' ELSE strftime(o_orderdate, '%Y-%m-%d') END, o_orderkey) AS place FROM orders""")
def report_order(spark: SparkSession, d: str) -> DataFrame:
    from auditlake.plans.report import ordered

    p = F.substring("o_orderpriority", 1, 1)
    level = F.when(p == "1", "high").when(p == "2", "medium").when(p == "3", "low").otherwise("watch")
    rows = table(spark, d, "orders").select("o_orderkey", level.alias("level"), (F.floor("o_totalprice") % 11).alias("score"), F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("effective_date"), F.col("o_orderkey").alias("pos"))
    return ordered(rows).select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("""SELECT 'orders' AS report, 'o' || o_orderkey AS location, 'total must be under 250000' AS message FROM orders WHERE o_totalprice >= 250000
UNION ALL SELECT 'orders', 'o' || o_orderkey, 'status must be F or O' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'events', 'e' || event_id, 'must have a key' FROM events WHERE json_extract(props, '$.k') IS NULL
UNION ALL SELECT 'events', 'e' || event_id, 'is a duplicate' FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n > 1""")
def violations_union(spark: SparkSession, d: str) -> DataFrame:
    at = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    o = table(spark, d, "orders").withColumn("report", F.lit("orders"))
    e = table(spark, d, "events").withColumn("report", F.lit("events")).withColumn("v", F.try_parse_json("props"))
    e = e.withColumn("again", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")) > 1)
    out = validation.found(o, [(at("o", "o_orderkey"), "total must be under 250000", F.col("o_totalprice") >= 250000), (at("o", "o_orderkey"), "status must be F or O", ~F.col("o_orderstatus").isin("F", "O"))])
    return out.unionByName(validation.found(e, [(at("e", "event_id"), "must have a key", F.coalesce(validation.kind_of(F.col("v"), "k"), F.lit("VOID")) == "VOID"), (at("e", "event_id"), "is a duplicate", F.col("again"))]))


@query("""SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'missing id' WHEN o_orderkey % 5 = 1 THEN 'mistyped score' WHEN o_orderkey % 5 = 2 THEN 'bad status' ELSE 'ok' END AS kind, count(*) AS n FROM orders GROUP BY 1""")
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    """Events in JSON, some broken in one of three ways, through the rules for events."""
    o = table(spark, d, "orders").withColumn("k", F.col("o_orderkey") % 5)
    zero = "{" + ",".join(f'"{x}":0' for x in K.BREAKDOWN) + "}"
    common_part = f'"level":"watch","score_breakdown":{zero},' + ",".join(f'"{x}":"x"' for x in ("title", "jurisdiction", "authority", "summary", "impact", "action", "rationale", "source_title"))
    rest = ',"published_date":null,"effective_date":null,"deadline":"2026-01-01","products_or_channels":[],"source_url":"https://x.org/","retrieved_date":"2026-01-01"'
    head = F.concat(F.when(F.col("k") == 0, "").otherwise('"id":"a",'), F.when(F.col("k") == 1, '"score":"0",').otherwise('"score":0,'), F.when(F.col("k") == 2, '"status":"odd",').otherwise('"status":"new",'))
    raw = F.concat(F.lit('{"events":[{'), head, F.lit(common_part + rest + "}]}"))
    rows = o.select(F.col("o_orderkey").cast("string").alias("report"), raw.alias("raw"))
    found = validation.event_rules(rows).select("report", F.when(F.col("location").endswith(".id"), "missing id").when(F.col("message") == "must be int", "mistyped score").when(F.col("message") == "is not a known status", "bad status").otherwise(F.concat("location", F.lit(" "), "message")).alias("kind"))
    return rows.select("report").join(found, "report", "left").groupBy(F.coalesce("kind", F.lit("ok")).alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey, n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900)""")
def scope_without_ledger(spark: SparkSession, d: str) -> DataFrame:
    rich = table(spark, d, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    return table(spark, d, "nation").join(rich, "n_nationkey", "left_anti").select("n_nationkey", "n_name")


@query("""WITH v AS (SELECT c_custkey, unnest([c_custkey * 2, c_custkey * 3]) AS id FROM customer)
SELECT v.c_custkey, v.id, CASE WHEN o_orderkey IS NULL THEN 'names no event' WHEN o_custkey <> v.c_custkey THEN 'names another platform''s event' ELSE 'ok' END AS outcome FROM v LEFT JOIN orders ON o_orderkey = v.id""")
def verified_ids_link(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "customer").select("c_custkey", F.explode(F.array(F.col("c_custkey") * 2, F.col("c_custkey") * 3)).alias("id"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    outcome = F.when(F.col("o_custkey").isNull(), "names no event").when(F.col("o_custkey") != F.col("c_custkey"), "names another platform's event").otherwise("ok")
    return v.join(o, "id", "left").select("c_custkey", "id", outcome.alias("outcome"))


def neighbours(spark: SparkSession, d: str, signals: bool = False) -> DataFrame:
    """Documents of a source beside the one before, as current (c) and previous (p) events.

    Ids are paired first, and the texts join them by id, so that a source with many documents is no hot key. With
    ``signals``, facts and obligations are read from a text before the join, and no text is joined.
    """
    docs = table(spark, d, "documents")
    day = F.concat(F.lit("2026-01-"), F.lpad((F.col("doc_id") % 5 + 10).cast("string"), 2, "0"))
    event = F.struct(
        F.col("lang").alias("jurisdiction"), F.col("source").alias("authority"), F.col("text").alias("summary"), F.when(F.col("n_chars") > 2000, "effective").otherwise("new").alias("status"),
        F.when(F.col("doc_id") % 3 == 0, day).alias("effective_date"), day.alias("deadline"), F.concat(F.lit("https://x.org/"), (F.col("n_chars") % 2).cast("string")).alias("source_url"),
        F.array(F.concat(F.lit("P "), (F.col("n_chars") % 3).cast("string"))).alias("products"), F.struct(F.lit("m").alias("platform"), (F.col("n_chars") % 4).cast("string").alias("program")).alias("policy"),
    )
    pairs = common.previous_in(docs, "source", "doc_id").filter("previous is not null")
    if signals:
        event = event.dropFields("summary").withField("signals", linkage.signals(F.col("text")))
    own = docs.select("doc_id", event.alias("c"))
    met = pairs.join(own, "doc_id").join(own.withColumnsRenamed({"doc_id": "previous", "c": "p"}), "previous")
    return met.select("doc_id", "previous", "source", "c", "p")


FACT_SQL = "list_sort(regexp_extract_all(lower(X), '\\d{4}[-/.年]\\d{1,2}(?:[-/.月]\\d{1,2}日?)?|\\b\\d{6,10}\\b|\\d+(?:[.,]\\d+)?\\s*(?:%|％|percent|percentage points?|个百分点|欧元|美元|元|days?|天|日|个月|months?|years?|年)'))"
OBLIGED = "list_filter(['allowed','cancelled','exempt','exemption','may not','must','prohibit','prohibited','required','requirement','resumed','suspended'], lambda t: contains(lower(X), t))"


DAY = "'2026-01-' || (doc_id % 5 + 10)"


@query(f"""WITH e AS (SELECT doc_id, source, lang, text, n_chars, n_chars > 2000 AS eff, CASE WHEN doc_id % 3 = 0 THEN {DAY} ELSE '' END AS effective, {DAY} AS deadline FROM documents),
n AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS pd FROM e),
r AS (SELECT c.doc_id, c.lang <> p.lang AS j, c.effective <> p.effective AS ef, c.deadline <> p.deadline AS dl, c.n_chars % 2 <> p.n_chars % 2 AS u, c.n_chars % 3 <> p.n_chars % 3 AS g, c.n_chars % 4 <> p.n_chars % 4 AS o,
  {FACT_SQL.replace("X", "c.text")} <> {FACT_SQL.replace("X", "p.text")} OR {OBLIGED.replace("X", "c.text")} <> {OBLIGED.replace("X", "p.text")} AS f, c.eff AND NOT p.eff AS s, c.effective = '2026-01-12' AS er, c.deadline = '2026-01-12' AS dr
  FROM n JOIN e c USING (doc_id) JOIN e p ON p.doc_id = n.pd),
m AS (SELECT *, concat_ws(',', CASE WHEN j THEN 'jurisdiction' END, CASE WHEN ef THEN 'effective_date' END, CASE WHEN dl THEN 'deadline' END, CASE WHEN u THEN 'source_url' END, CASE WHEN g THEN 'products_or_channels' END,
  CASE WHEN o THEN 'platform_policy.program' END, CASE WHEN f THEN 'summary_facts_or_obligation' END) AS material,
  concat_ws(',', CASE WHEN s THEN 'status:new->effective' END, CASE WHEN er THEN 'effective_date_reached' END, CASE WHEN dr THEN 'deadline_reached' END) AS reached FROM r)
SELECT doc_id, CASE WHEN material <> '' THEN 'material_update' WHEN reached <> '' THEN 'operational_refresh' ELSE 'duplicate_removed' END AS disposition, CASE WHEN material <> '' THEN material ELSE reached END AS reasons FROM m""")
def classify_change(spark: SparkSession, d: str) -> DataFrame:
    """Material and operational reasons with all fields, on a report of the day that some dates name."""
    columns = ["jurisdiction", "authority", "effective_date", "deadline", "source_url", "products", "policy", "signals"]
    pairs = neighbours(spark, d, signals=True)
    for side in "cp":
        pairs = pairs.withColumn(side, F.col(side).withField("policy", F.struct(*[F.col(f"{side}.policy.program").alias(n) if n == "program" else F.lit("x").alias(n) for n in K.POLICY_FIELDS])))
    out = linkage.classify(pairs, "c", "p", F.lit("2026-01-12"), F.lit("2026-01-11"), columns)
    return out.select("doc_id", "disposition", F.array_join("change_reasons", ",").alias("reasons"))


@query(f"""WITH e AS (SELECT doc_id, source, n_chars > 2000 AS eff, CASE WHEN doc_id % 3 = 0 THEN {DAY} ELSE '' END AS effective, {DAY} AS deadline FROM documents),
n AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS pd FROM e)
SELECT c.doc_id, concat_ws(',', CASE WHEN c.eff AND NOT p.eff THEN 'status:new->effective' END, CASE WHEN c.effective = '2026-01-12' THEN 'effective_date_reached' END, CASE WHEN c.deadline = '2026-01-12' THEN 'deadline_reached' END) AS reasons,
  concat_ws(',', CASE WHEN c.eff AND NOT p.eff THEN 'status:new->effective' END) AS same_day FROM n JOIN e c USING (doc_id) JOIN e p ON p.doc_id = n.pd""")
def dates_reached(spark: SparkSession, d: str) -> DataFrame:
    """Dates count as reached on a new day alone."""
    joined = lambda now, old: F.array_join(linkage.operational_reasons("c", "p", F.lit(now), F.lit(old)), ",")
    return neighbours(spark, d).select("doc_id", joined("2026-01-12", "2026-01-11").alias("reasons"), joined("2026-01-12", "2026-01-12").alias("same_day"))


# -- linkage and clusters: string similarity has no SQL ------------------------------------------------------------


def titled(spark: SparkSession, d: str) -> DataFrame:
    """Documents as events: the first sentence as title, the whole text as summary, language and source as scope and authority."""
    docs = table(spark, d, "documents")
    none = F.lit("")
    return docs.select(
        F.col("doc_id").alias("pos"), none.alias("id"), F.trim(F.regexp_extract("text", r"^[^.!?\n]*", 0)).alias("title"), F.col("text").alias("summary"), none.alias("source_title"),
        F.col("source").alias("authority"), F.col("lang").alias("jurisdiction"), F.array().cast("array<string>").alias("products"), none.alias("source_url"), F.lit("new").alias("status"),
        F.lit(None).cast("string").alias("effective_date"), F.lit(None).cast("string").alias("deadline"),
    )


@query()
def dedup_fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """Even documents matched one to one with odd ones of their language."""
    rows = titled(spark, d)
    return linkage.match_events(rows.filter("pos % 2 = 0"), rows.filter("pos % 2 = 1")).select("ci", "pi", F.round("score", 3).alias("similarity"))


def leads(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    lang = F.regexp_extract("url", "/(en|fr|de|es)/", 1)
    return p.select(
        F.col("page_id").alias("pos"), ids.lead_id(F.col("url"), title, F.lit("2026-07-20T00:00:00+00:00")).alias("lead_id"), title.alias("source_title"), "url", F.col("url").alias("source_url"),
        F.when(F.col("url").contains("example.org"), "official_lead").otherwise("trade_media").alias("source_tier"), F.lit("2026-07-20T00:00:00+00:00").alias("published_at"), lang.alias("jurisdiction"),
        text.authority(F.col("url")).alias("platform"), F.array(lang).alias("products"), F.array().cast("array<string>").alias("hs_codes"), title.alias("claim"), (F.col("page_id") % 6).cast("int").alias("momentum_score"),
    )


@query()
def lead_clusters(spark: SparkSession, d: str) -> DataFrame:
    return discovery.prioritize(leads(spark, d), "2026-07-21T00:00:00+00:00", regions=["en"]).select("cluster_id", "priority_score", "domains", F.size("lead_ids").alias("leads"), "qualified", "rank")


@query("""WITH RECURSIVE e AS (SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 7 AND a.c_nationkey % 2 = b.c_nationkey % 2),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT c_custkey AS node, c_custkey AS seen FROM customer UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a)
SELECT node, min(seen) AS component FROM r GROUP BY node""")
def semantic_components(spark: SparkSession, d: str) -> DataFrame:
    """Customers seven apart whose nations have the same parity: smallest reachable key."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    a, b = c.alias("a"), c.alias("b")
    edges = a.join(b, F.col("b.c_custkey") == F.col("a.c_custkey") + 7).filter(F.col("a.c_nationkey") % 2 == F.col("b.c_nationkey") % 2).select(F.col("a.c_custkey").alias("a"), F.col("b.c_custkey").alias("b"))
    return graph.components(c.select(F.col("c_custkey").alias("node")), edges)


@query()
def unified_diff_summary(spark: SparkSession, d: str) -> DataFrame:
    """Line diffs of neighbouring documents of a source."""
    common.small_batches(spark)
    n = neighbours(spark, d).select("doc_id", udfs.diff_summary("p.summary", "c.summary").alias("x"))
    return n.select("doc_id", "x.summary", "x.added", "x.removed")


@query("""SELECT page_id, 'T ' || page_id AS title, 'https://x.org/' || page_id AS url, '2026-07-01' AS published_at FROM pages""")
def feed_parse(spark: SparkSession, d: str) -> DataFrame:
    """A feed made of each page and read again."""
    from auditlake.sources.feeds import entries

    k = F.col("page_id").cast("string")
    rss = F.concat(F.lit("<rss><channel><item><title>T "), k, F.lit("</title><link>https://x.org/"), k, F.lit("</link><pubDate>2026-07-01</pubDate></item><item><title>no link</title></item></channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T '), k, F.lit('</title><link rel="self" href="https://y.org/"/><link href="https://x.org/'), k, F.lit('"/><updated>2026-07-01</updated></entry></feed>'))
    feeds = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, rss).otherwise(atom).alias("content"))
    return entries(feeds).select("page_id", "title", "url", "published_at")


def streamed(spark: SparkSession, rows: DataFrame, name: str, plan) -> DataFrame:  # noqa: ANN001
    """What a query over a file stream of these rows has written when the stream is at its end."""
    import uuid

    folder = f"{common.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/in")
    stream = plan(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("append").start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(SQL["change_chain"])
def stream_change_chain(spark: SparkSession, d: str) -> DataFrame:
    """The chain from a file stream with state for each page, run to its end."""
    from auditlake.streaming.changes import change_stream

    rows = captures(spark, d).withColumn("content_hash", F.col("content_hash").cast("string")).withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    out = streamed(spark, rows, "chain", lambda s: change_stream(s.select("page_key", "snapshot_id", "captured_at", "content_hash")))
    return out.select("page_key", "snapshot_id", "previous_snapshot_id", "change_status")


@query(f"""WITH {LATE}, b AS (SELECT *, max(captured_at) OVER o AS top FROM late WINDOW o AS (PARTITION BY page_key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, top IS NULL OR captured_at >= top AS taken FROM b),
p AS (SELECT *, max(CASE WHEN taken THEN event_id END) OVER (PARTITION BY page_key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM a)
SELECT p.page_key, p.snapshot_id, q.snapshot_id AS previous_snapshot_id, CASE WHEN NOT taken THEN 'rejected' WHEN prev IS NULL THEN 'first_seen' WHEN q.content_hash = p.content_hash THEN 'unchanged' ELSE 'changed' END AS change_status
FROM p LEFT JOIN late q ON q.event_id = p.prev""")
def stream_late_captures(spark: SparkSession, d: str) -> DataFrame:
    """A stream whose captures arrive late, in order of arrival: a store of the sqlite kind refuses those before its latest."""
    from auditlake.streaming.changes import change_stream

    rows = late_captures(spark, d).withColumn("captured_at", F.col("captured_at").cast("timestamp")).drop("event_id")
    out = streamed(spark, rows, "late", lambda s: change_stream(s, "sqlite", "seq"))
    return out.select("page_key", "snapshot_id", "previous_snapshot_id", "change_status")


@query("""SELECT user_id::VARCHAR || '/' || event_type AS signature, count(*) > 0 AS told FROM events GROUP BY ALL""")
def stream_alert_once(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of a stream, each signature once within the delay; all events lie within it here."""
    from auditlake.streaming.changes import alert_once

    rows = table(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("signature"), F.col("ts").cast("timestamp").alias("ts"))
    return streamed(spark, rows, "alerts", lambda s: alert_once(s, "3650 days")).groupBy("signature").agg((F.count("*") == 1).alias("told"))


@query("""SELECT user_id AS task_id, event_id % 5 AS content_hash, 1::BIGINT AS n FROM events GROUP BY ALL""")
def stream_idempotent_receipts(spark: SparkSession, d: str) -> DataFrame:
    """Receipts that are replayed on a stream count once."""
    from auditlake.streaming.changes import idempotent

    rows = table(spark, d, "events").select(F.col("user_id").alias("task_id"), (F.col("event_id") % 5).alias("content_hash"), F.col("ts").cast("timestamp").alias("ts"))
    return streamed(spark, rows, "receipts", lambda s: idempotent(s, "3650 days")).groupBy("task_id", "content_hash").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, event_id, ts, last_value(CASE WHEN event_id % 3 = 0 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM events),
r AS (SELECT e.*, held % 9 <> 0 AND e.ts - h.ts <= INTERVAL 36 HOUR AS good FROM e LEFT JOIN (SELECT event_id AS held, ts FROM events) h USING (held) WHERE event_id % 3 <> 0)
SELECT user_id::VARCHAR AS task_id, event_id::VARCHAR AS ref, CASE WHEN good THEN 'reused' ELSE 'fetch' END AS outcome, CASE WHEN good THEN held::VARCHAR END AS receipt_ref FROM r""")
def stream_ttl_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Lookups on a stream, answered from receipts that expire: a third of the events are receipts, some of which failed."""
    from auditlake.streaming.receipts import fresh_receipts

    e, n = table(spark, d, "events"), F.col("event_id")
    rows = e.select(F.col("user_id").cast("string").alias("task_id"), F.when(n % 3 == 0, "receipt").otherwise("lookup").alias("kind"), F.col("ts").cast("timestamp").alias("at"), n.alias("seq"), n.cast("string").alias("ref"), F.when(n % 9 == 0, "timeout").otherwise("candidate_found").alias("result"))
    out = streamed(spark, rows, "fresh", lambda s: fresh_receipts(s, 36 * 3600))
    return out.filter("outcome in ('reused', 'fetch')").select("task_id", "ref", "outcome", "receipt_ref")


def accepted(body: list[str], key: str) -> None:
    """A receiver that takes every chunk."""


@query("""SELECT DISTINCT user_id::VARCHAR || '/' || event_type AS signature, 1::BIGINT AS sent FROM events""")
def stream_outbox_delivery(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of a stream that pass through an outbox: each signature is in one delivered chunk."""
    import uuid

    from auditlake.streaming import outbox

    folder = f"{common.shared_dir(spark)}/outbox-{uuid.uuid4().hex}"
    rows = table(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("signature"), F.to_json(F.struct("event_id", "value")).alias("body"))
    rows.repartition(3, "signature").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    outbox.start(stream, f"{folder}/box", accepted).awaitTermination()
    return outbox.delivered(spark, f"{folder}/box").groupBy("signature").agg(F.count("*").alias("sent"))


@query("""SELECT a.user_id::VARCHAR AS key, a.event_id AS receipt, b.event_id AS capture FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id % 4 = 0 AND b.event_id % 4 <> 0
  AND b.ts BETWEEN a.ts - INTERVAL 24 HOUR AND a.ts + INTERVAL 30 MINUTE""")
def stream_horizon_join(spark: SparkSession, d: str) -> DataFrame:
    """Captures of a day before each receipt and half an hour after it, joined as two streams."""
    from auditlake.streaming.horizons import within

    n = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), n, F.col("ts").cast("timestamp").alias("ts"))
    side = lambda s, which, name, at: s.filter(which).select("key", n.alias(name), F.col("ts").alias(at))
    out = streamed(spark, rows, "horizons", lambda s: within(side(s, n % 4 == 0, "receipt", "checked_at"), side(s, n % 4 != 0, "capture", "captured_at"), ahead="30 minutes", delay="3650 days"))
    return out.select("key", "receipt", "capture")
