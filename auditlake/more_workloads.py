"""Further queries over the synthetic tables: text, dates, identities, acquisition, worksheets, clusters, files.

As in ``workloads``: every query calls the operators it is about, and its SQL says the same in other words.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake import fault_workloads as faults
from auditlake.functions import ids, score, text, timing, udfs
from auditlake.operators import acquisition, calibration, chains, common, discovery, evaluation, graph, library, library_index, linkage, planning, snapshots, worksheet
from auditlake.workloads import CAPTURES, CHAIN, CONSENSUS, SQL, captures, predictions, query, reviews, table


def _none() -> Column:
    return F.lit(None).cast("string")


def _array(*items: Column) -> Column:
    return F.array(*items).cast("array<string>")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _case(column: str, of: dict[str, str]) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return f"CASE {column} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in of.items()) + " END"


# -- text and dates ----------------------------------------------------------------------------------------------------

TRIM = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH l AS (SELECT doc_id, list_transform(regexp_split_to_array(replace(text, '. ', '  ' || chr(10) || ' '), '\\r\\n|[\\n\\r]'), lambda x: {TRIM}) AS w FROM documents)
SELECT doc_id, array_to_string(list_filter(list_transform(w, lambda x: regexp_replace(x, '\\s+', ' ', 'g')), lambda x: x <> ''), chr(10)) AS page, array_to_string(list_filter(w, lambda x: x <> ''), chr(10)) AS evidence FROM l""")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """Page text has its inner white space collapsed, evidence text keeps it; blank lines go from both."""
    c = F.replace(F.col("text"), F.lit(". "), F.lit("  \n "))
    common.small_batches(spark)
    return table(spark, d, "documents").select("doc_id", udfs.both_lines(c).alias("x")).select("doc_id", "x.page", "x.evidence")


@query("""SELECT p_partkey, trim(regexp_replace(lower('  ' || p_name || '   ' || p_type || ' '), '\\s+', ' ', 'g')) AS spaced,
  CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_brand || '|' || p_type END AS kept, array_to_string(list_sort(list_distinct([array_to_string(regexp_extract_all(lower(p_brand), '[a-z0-9_]+'), ' '), array_to_string(regexp_extract_all(lower(p_type), '[a-z0-9_]+'), ' ')])), '|') AS words,
  'run-' || p_size AS run FROM part""")
def strings_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Collapsed texts, non-blank distinct strings in order, normalised sets, and run names from file names."""
    p = table(spark, d, "part")
    other = F.when(F.col("p_size") % 2 == 0, " ").otherwise(F.col("p_type"))
    kept = text.distinct_strings(F.array(F.concat(F.lit(" "), "p_brand"), F.col("p_brand"), other, F.concat("p_brand", F.lit(" ")), F.lit("")))
    words = text.normalized_set(F.array(F.upper("p_brand"), F.col("p_type"), F.col("p_brand"), F.lit("--")))
    name = F.concat(F.lit("run-"), _text("p_size"), F.lit(".labels.json"))
    said = F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type", F.lit(" "))
    return p.select("p_partkey", text.spaced(said).alias("spaced"), F.array_join(kept, "|").alias("kept"), F.array_join(words, "|").alias("words"), text.run_name(name).alias("run"))


SHAPES = ("o_day", "o_day || 'x'", "'2026-02-30'", "'2026-2-3'", "''", "o_day || 'T10:00:00'", "o_day || 'T10:00:00Z'", "o_day || 'T10:00:00.5+02:00'", "o_day || ' 25:00:00+00:00'")
DATED = "SELECT o_orderkey, o_orderkey % 9 AS k, strftime(o_orderdate, '%Y-%m-%d') AS o_day FROM orders"


@query(f"SELECT o_orderkey, k = 0 AS is_date, k IN (6, 7) AS is_instant FROM ({DATED})")
def iso_dates(spark: SparkSession, d: str) -> DataFrame:
    """Nine shapes of text: one is a date, two are instants with an offset."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 9).alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_day"))
    shown = F.element_at(F.array(*[F.expr(s) for s in SHAPES]), (F.col("k") + 1).cast("int"))
    return o.select("o_orderkey", timing.valid_date(shown).alias("is_date"), timing.valid_instant(shown).alias("is_instant"))


@query("""WITH h AS (SELECT event_id, ts, event_id % 400 AS back FROM events)
SELECT event_id, back >= 168 AS long_enough, ts - INTERVAL 24 HOUR AS start, ts + INTERVAL 30 DAY AS until, least(ts - INTERVAL 24 HOUR, ts - INTERVAL 7 DAY) AS platform_start, (back * 3600)::DOUBLE AS age FROM h""")
def windows(spark: SparkSession, d: str) -> DataFrame:
    """Look-backs of at least seven days, and the windows that a cutoff implies."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    start = F.col("ts") - F.make_dt_interval(hours=(F.col("event_id") % 400).cast("int"))
    w = timing.default_window(F.col("ts"))
    plain = lambda c: c.cast("timestamp_ntz")
    return e.select("event_id", timing.lookback_ok(start, F.col("ts")).alias("long_enough"), plain(w["start"]).alias("start"), plain(w["end"]).alias("until"), plain(w["platform_start"]).alias("platform_start"), timing.seconds_between(start, F.col("ts")).alias("age"))


# -- scopes, scores and levels -------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT c_custkey, ['us', 'China', 'unknown', 'U.S.', 'prc'][c_custkey % 5 + 1] AS a, ['united states', 'cn', '', 'eu'][c_custkey % 4 + 1] AS b, c_mktsegment AS p, CASE WHEN c_nationkey % 2 = 0 THEN upper(c_mktsegment) ELSE 'N/A' END AS q FROM customer),
k AS (SELECT *, CASE WHEN a IN ('us', 'U.S.') THEN 'united states' WHEN a IN ('China', 'prc') THEN 'china' END AS x, CASE b WHEN 'united states' THEN b WHEN 'cn' THEN 'china' WHEN 'eu' THEN 'european union' END AS y, lower(p) AS u, CASE WHEN q = 'N/A' THEN 'n a' ELSE lower(q) END AS v FROM s)
SELECT c_custkey, coalesce(x <> y, false) OR coalesce(u <> v, false) AS clash FROM k""")
def scope_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Scopes clash where both are known and differ, by their canonical names."""
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("c_custkey") % len(values) + 1).cast("int"))
    a, b = pick(("us", "China", "unknown", "U.S.", "prc")), pick(("united states", "cn", "", "eu"))
    q = F.when(F.col("c_nationkey") % 2 == 0, F.upper("c_mktsegment")).otherwise("N/A")
    return table(spark, d, "customer").select("c_custkey", text.conflicts([(a, b), (F.col("c_mktsegment"), q)]).alias("clash"))


@query("""SELECT l_orderkey, l_linenumber, least(20, CASE WHEN l_orderkey % 2 = 0 THEN 8 ELSE 0 END + CASE WHEN l_partkey % 3 = 0 THEN 6 ELSE 0 END + CASE WHEN l_suppkey % 4 = 0 THEN 6 WHEN l_linenumber = 1 THEN 3 ELSE 0 END) AS relevance,
  CASE WHEN l_discount >= 0.05 THEN 'high' WHEN l_discount >= 0.02 THEN 'medium' ELSE 'low' END AS confidence, round(l_quantity - l_linenumber / 3.0, 4) AS delta,
  CASE WHEN l_tax = 0 AND l_discount = 0 THEN 0 ELSE round(2 * l_tax * l_discount / (l_tax + l_discount), 4) END AS f1 FROM lineitem""")
def scores_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Relevance, confidence, deltas and F1 of order lines."""
    li = table(spark, d, "lineitem")
    relevance = score.relevance(F.col("l_orderkey") % 2 == 0, F.col("l_partkey") % 3 == 0, F.col("l_suppkey") % 4 == 0, F.col("l_linenumber") == 1)
    sure = score.confidence(F.col("l_discount") + 0.9, 0.92 - 1e-9)
    return li.select(
        "l_orderkey", "l_linenumber", relevance.alias("relevance"), F.when(F.col("l_discount") >= 0.05, score.confidence(F.lit(0.95), 0.9)).otherwise(sure).alias("confidence"),
        score.numeric_delta(F.col("l_quantity"), F.col("l_linenumber") / 3.0).alias("delta"), score.f1(F.col("l_tax"), F.col("l_discount")).alias("f1"),
    )


# -- identities ----------------------------------------------------------------------------------------------------------


def _hash(*parts: str, n: int = 64) -> str:
    return f"substr(sha256({' || '.join(parts)}), 1, {n})"


Q = lambda name, value: f"'\"{name}\":\"' || {value} || '\"'"  # noqa: E731  a JSON field of text


@query(f"""SELECT c_custkey, {_hash("c_name || chr(10) || c_mktsegment || chr(10) || c_nationkey", n=24)} AS task_id, {_hash("lower(c_name || chr(10) || c_mktsegment)", n=24)} AS source_id,
  {_hash("'{' || " + Q("cutoff", "c_custkey") + " || ',' || " + Q("report_date", "c_nationkey") + " || ',\"scope\":[' || '\"' || c_mktsegment || '\"]}'", n=24)} AS report_key,
  {_hash("'{' || " + " || ',' || ".join(Q(f, "c_name") if f == "id" else f"'\"{f}\":null'" for f in sorted(K.SIGNATURE_FIELDS)) + " || '}'")} AS signature,
  {_hash("'{' || " + Q("authority", "lower(c_mktsegment)") + " || ',' || " + Q("title", "array_to_string(regexp_extract_all(lower(c_name), '[a-z0-9_]+'), ' ')") + " || '}'")} AS fingerprint FROM customer""")
def hashed_identities(spark: SparkSession, d: str) -> DataFrame:
    """Ids of tasks, sources and reports, alert signatures and review fingerprints."""
    fields = {f: (F.col("c_name") if f == "id" else _none()) for f in K.SIGNATURE_FIELDS}
    return table(spark, d, "customer").select(
        "c_custkey", ids.task_id(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")).alias("task_id"), ids.source_id(F.col("c_name"), F.col("c_mktsegment")).alias("source_id"),
        ids.report_key(_text("c_nationkey"), _text("c_custkey"), F.array("c_mktsegment")).alias("report_key"), ids.signature(fields).alias("signature"),
        ids.fingerprint({"title": F.col("c_name"), "authority": F.col("c_mktsegment")}).alias("fingerprint"),
    )


@query(f"""WITH l AS (SELECT c_nationkey, array_to_string(list_sort(list(c_name)), chr(10)) AS names FROM customer GROUP BY 1) SELECT c_nationkey, {_hash("names", n=24)} AS cluster_id FROM l""")
def cluster_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_nationkey").agg(ids.cluster_id(F.collect_list("c_name")).alias("cluster_id"))


@query(f"""WITH j AS (SELECT o_orderkey, o_custkey % 4 AS run, '{{"a":[1,{{"b":null,"é":"x"}}],"k":' || o_orderkey || ',"z":"' || o_orderstatus || '"}}' AS canonical FROM orders),
h AS (SELECT run, sha256(canonical) AS hash, o_orderkey FROM j)
SELECT o_orderkey, hash, NULL AS history_hash FROM h UNION ALL SELECT NULL, NULL, sha256(array_to_string(list_transform(list_sort(list({{'p': o_orderkey, 'h': hash}})), lambda x: x.h), '')) FROM h WHERE run = 1""")
def dataset_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of JSON do not depend on its blanks and the order of its keys; a history's is one over its runs' in order."""
    o = table(spark, d, "orders")
    raw = F.concat(F.lit('{ "z": "'), "o_orderstatus", F.lit('", "k":'), _text("o_orderkey"), F.lit(', "a": [1, {"é": "x", "b": null}]}'))
    rows = o.select("o_orderkey", (F.col("o_custkey") % 4).alias("run"), evaluation.content_hash(raw).alias("hash"))
    whole = evaluation.history_hash(rows.filter("run = 1").select(F.col("o_orderkey").alias("run_pos"), "hash"))
    return rows.select("o_orderkey", "hash", _none().alias("history_hash")).unionByName(whole, allowMissingColumns=True)


# -- platforms, tasks, coverage, health ----------------------------------------------------------------------------------


@query("""WITH s AS (SELECT c_custkey, 'Sales in ' || n_name || ' and ' || lower(n_name) || 'x' AS scope FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, n_name AS platform FROM s, nation WHERE regexp_matches(lower(scope), '(^|[^a-z0-9])' || lower(n_name) || '($|[^a-z0-9])')""")
def scope_alias_hits(spark: SparkSession, d: str) -> DataFrame:
    """Platforms (nations) that customers' scopes name as whole words."""
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    scopes = c.select("c_custkey", F.concat(F.lit("Sales in "), "n_name", F.lit(" and "), F.lower("n_name"), F.lit("x")).alias("scope"))
    found = acquisition.named_platforms(scopes.select("scope").distinct(), n.select(F.upper("n_name").alias("alias"), F.col("n_name").alias("platform")))
    return scopes.join(found, "scope").select("c_custkey", "platform")


@query("""WITH a AS (SELECT lower(n_name) AS alias, n_name AS platform FROM nation UNION SELECT 'region ' || n_regionkey, n_name FROM nation UNION SELECT 'nation ' || n_nationkey, n_name FROM nation),
n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'nation ' || c_nationkey ELSE 'nobody' END AS name FROM customer)
SELECT c_custkey, platform, (SELECT count(*) FROM (SELECT alias FROM a GROUP BY alias HAVING count(DISTINCT platform) > 1)) AS ambiguous FROM n LEFT JOIN a ON alias = name""")
def platform_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Names resolved by aliases, and how many aliases are claimed twice."""
    n = table(spark, d, "nation")
    name = lambda c: n.select(c.alias("alias"), F.col("n_name").alias("platform"))
    aliases = name(F.col("n_name")).union(name(F.concat(F.lit("Region: "), _text("n_regionkey")))).union(name(F.concat(F.lit("NATION "), _text("n_nationkey"))))
    names = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("nation-"), _text("c_nationkey"))).otherwise("nobody").alias("name"))
    twice = acquisition.ambiguous_aliases(aliases).count()
    return acquisition.resolve(names, aliases).select("c_custkey", "platform", F.lit(twice).cast("long").alias("ambiguous"))


KINDS = ("official_updates", "current_policy", "dashboard")
START = "2026-07-01T00:00:00+00:00"
TASKS = f"""r AS (SELECT s_suppkey, n_name AS platform, ['{KINDS[0]}', '{KINDS[1]}', '{KINDS[2]}'][s_suppkey % 3 + 1] AS source_type, 'https://x.org/' || s_suppkey AS url, s_suppkey % 4 <> 0 AS verified, s_suppkey % 5 <> 0 AS fits FROM supplier JOIN nation ON s_nationkey = n_nationkey),
t AS (SELECT *, substr(sha256(platform || chr(10) || 'US' || chr(10) || 'P' || chr(10) || source_type || chr(10) || url || chr(10) || '{START}'), 1, 24) AS task_id, source_type = 'dashboard' AS requires_auth, NOT verified OR NOT fits AS needs FROM r)"""


def routes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    return s.select(
        "s_suppkey", F.col("n_name").alias("platform"), F.element_at(F.array(*[F.lit(x) for x in KINDS]), (k % 3 + 1).cast("int")).alias("source_type"), F.concat(F.lit("https://x.org/"), k.cast("string")).alias("url"),
        F.array(F.when(k % 5 != 0, "US").otherwise("EU")).alias("markets"), F.when(k % 4 != 0, "verified").otherwise("conditional").alias("verification_status"), F.lit(False).alias("verify_before_use"),
    )


@query(f"WITH {TASKS} SELECT task_id, platform, requires_auth, needs AS route_verification_required, row_number() OVER (ORDER BY lower(platform), source_type, url) AS place FROM t")
def tasks_of_routes(spark: SparkSession, d: str) -> DataFrame:
    """A task for each route, in order; those that need no login are public."""
    return common.numbered(acquisition.tasks(routes(spark, d), "US", "P", START)).select("task_id", "platform", "requires_auth", "route_verification_required", "place")


#: Receipts of suppliers' tasks: by the key some lack one, and results, errors, snapshots and routes differ.
SEEN = f"""{TASKS}, v AS (SELECT *, ['no_relevant_update', 'candidate_found', 'verified_event', 'login_required', 'blocked', 'not_applicable', 'verified_event'][s_suppkey % 7 + 1] AS result, CASE WHEN s_suppkey % 11 = 0 THEN 'TimeoutError' END AS error_type,
  s_suppkey % 2 = 0 AS shot, s_suppkey % 3 = 0 AS checked_route, CASE WHEN s_suppkey % 9 = 0 THEN 'browser_authenticated' ELSE 'http' END AS method, '2026-07-' || lpad((s_suppkey % 20 + 1)::VARCHAR, 2, '0') || 'T00:00:00+00:00' AS checked_at, s_suppkey % 8 <> 0 AS seen FROM t)"""


def task_receipts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = routes(spark, d)
    tasks = acquisition.tasks(r, "US", "P", START)
    k = F.substring_index("url", "/", -1).cast("long")
    results = ("no_relevant_update", "candidate_found", "verified_event", "login_required", "blocked", "not_applicable", "verified_event")
    day = F.concat(F.lit("2026-07-"), F.lpad((k % 20 + 1).cast("string"), 2, "0"), F.lit("T00:00:00+00:00"))
    rows = tasks.filter(k % 8 != 0).select(
        "task_id", k.alias("pos"), F.element_at(F.array(*[F.lit(x) for x in results]), (k % 7 + 1).cast("int")).alias("result"), F.when(k % 11 == 0, "TimeoutError").alias("error_type"), F.lit(200).alias("http_status"),
        F.when(k % 2 == 0, "snap").alias("snapshot"), (k % 3 == 0).alias("route_verified"), F.when(k % 9 == 0, "browser_authenticated").otherwise("http").alias("retrieval_method"), day.alias("checked_at"), F.col("url").alias("final_url"),
    )
    old = rows.withColumn("checked_at", F.lit("2026-06-01T00:00:00+00:00")).withColumn("result", F.lit("blocked"))
    return tasks, rows.unionByName(old)


POSITIVE = "result IN ('no_relevant_update', 'candidate_found', 'verified_event')"


@query(f"""WITH {SEEN}, g AS (SELECT *, CASE WHEN NOT seen THEN 1 ELSE (needs AND NOT checked_route)::INT + (source_type <> 'dashboard' AND {POSITIVE} AND NOT shot)::INT END AS n_gaps FROM v)
SELECT platform, bool_or(seen AND source_type = 'official_updates') AS public_update_checked, bool_or(seen AND source_type = 'current_policy') AS current_policy_checked, bool_or(seen AND source_type = 'dashboard') AS dashboard_checked,
  CASE WHEN bool_or(seen AND method = 'browser_authenticated' AND {POSITIVE}) THEN 'checked_authenticated' WHEN bool_or(seen AND result = 'login_required') THEN 'login_required' WHEN bool_or(seen AND result = 'blocked') THEN 'blocked' WHEN bool_or(seen) THEN 'public_checked' ELSE 'not_checked' END AS access_result,
  coalesce(max(CASE WHEN seen THEN checked_at END), '2026-07-30') AS checked_at, sum(n_gaps)::BIGINT + 1 AS n_gaps, row_number() OVER (ORDER BY platform) AS place FROM g GROUP BY platform""")
def coverage_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger of platforms in order: flags, the access that was reached, and gaps, one of them declared for each."""
    tasks, seen = task_receipts(spark, d)
    gaps = table(spark, d, "nation").select(F.col("n_name").alias("platform"), F.lit("US").alias("seller_market"), F.lit("P").alias("program"), F.lit("dashboard").alias("source_type"), F.lit("none").alias("reason"))
    gaps = gaps.join(tasks.select("platform").distinct(), "platform", "left_semi")
    rows = common.numbered(acquisition.coverage(tasks, seen, "2026-07-30", gaps))
    return rows.select("platform", "public_update_checked", "current_policy_checked", "dashboard_checked", "access_result", "checked_at", F.size("gaps").cast("long").alias("n_gaps"), "place")


STATED = """CASE WHEN NOT seen THEN 'not_checked' WHEN error_type = 'TimeoutError' THEN 'timeout' WHEN result IN ('blocked', 'login_required') THEN result WHEN result IN ('not_applicable', 'candidate_found') THEN 'partial'
  WHEN needs AND NOT checked_route THEN 'partial' WHEN source_type <> 'dashboard' AND NOT shot THEN 'partial' WHEN result = 'no_relevant_update' THEN result ELSE 'ok' END"""


@query(f"""WITH {SEEN}, h AS (SELECT *, {STATED} AS audit_state FROM v)
SELECT url, audit_state, CASE WHEN requires_auth AND audit_state = 'not_checked' THEN '{K.DASHBOARD_HINT}' ELSE {_case("audit_state", K.FIX_HINTS)} END AS fix_hint, substr(sha256(lower(platform || chr(10) || 'US' || chr(10) || 'P' || chr(10) || source_type || chr(10) || url)), 1, 24) AS source_id,
  row_number() OVER (ORDER BY lower(platform), source_type, url) AS place FROM h""")
def source_health_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every task's state, hint and source id, in the order of five keys."""
    tasks, seen = task_receipts(spark, d)
    return common.numbered(acquisition.health(tasks, seen)).select("url", "audit_state", "fix_hint", "source_id", "place")


DASH = f"""{SEEN}, h AS (SELECT *, {STATED} AS audit_state FROM v), b AS (SELECT platform, count(DISTINCT audit_state) FILTER (audit_state IN ('blocked', 'timeout')) AS bad FROM h GROUP BY 1),
a AS (SELECT platform, count(DISTINCT source_type) AS types, bool_and(verified) AS all_ok, count(*) FILTER (verified AND s_suppkey % 2 = 0) AS pub, count(*) FILTER (NOT verified) AS cond FROM r GROUP BY platform),
x AS (SELECT *, CASE WHEN types >= 3 AND all_ok AND pub >= 1 THEN 'full' WHEN types >= 2 THEN 'hybrid' ELSE 'constrained' END AS depth FROM a),
y AS (SELECT platform, depth, bad, least(100, CASE depth WHEN 'full' THEN 0 WHEN 'hybrid' THEN 40 ELSE 70 END + 20 * (3 - types) + 10 * cond + CASE WHEN pub = 0 THEN 15 ELSE 0 END + 10 * bad)::BIGINT AS priority FROM x JOIN b USING (platform))"""


def _dashboard(spark: SparkSession, d: str) -> DataFrame:
    tasks, seen = task_receipts(spark, d)
    access = F.when(F.col("s_suppkey") % 2 == 0, "public").otherwise("authenticated")
    own = routes(spark, d).withColumn("access", access).withColumn("last_verified_on", _none())
    return acquisition.dashboard(own, acquisition.health(tasks, seen).withColumn("platform", F.upper("platform")))


@query(f"WITH {DASH} SELECT platform, priority, bad, row_number() OVER (ORDER BY priority DESC, lower(platform)) AS place FROM y")
def dashboard_with_health(spark: SparkSession, d: str) -> DataFrame:
    """Health rows join platforms by their names without case, and failures raise the priority; in order."""
    return common.numbered(_dashboard(spark, d)).select("platform", F.col("priority").cast("long").alias("priority"), "bad", "place")


@query(f"""WITH {DASH} SELECT count(*) AS platforms, count(*) FILTER (depth = 'full') AS "full", count(*) FILTER (depth = 'hybrid') AS hybrid, count(*) FILTER (depth = 'constrained') AS constrained, count(*) FILTER (priority > 0) AS needing_work FROM y""")
def dashboard_totals(spark: SparkSession, d: str) -> DataFrame:
    return acquisition.dashboard_summary(_dashboard(spark, d))


@query(f"""WITH {SEEN} SELECT task_id, source_type, url, result, coalesce(CASE WHEN s_suppkey % 5 = 0 THEN 'n' END, '') AS notes, method FROM v WHERE seen""")
def source_entries(spark: SparkSession, d: str) -> DataFrame:
    """Receipts as entries of the ledger, each with its receipt."""
    tasks, seen = task_receipts(spark, d)
    rows = acquisition.latest_receipts(seen).join(tasks.select("task_id", "platform", "seller_market", "program", "source_type", F.col("url").alias("requested_url")), "task_id")
    rows = rows.withColumns({"final_url": _none(), "notes": F.when(F.col("pos") % 5 == 0, "n"), "attempts": F.lit(1), "content_hash": _none(), "content_ref": _none()})
    out = acquisition.source_entries(rows)
    return out.select("source.acquisition_receipt.task_id", "source.source_type", "source.url", "source.result", "source.notes", F.col("source.acquisition_receipt.retrieval_method").alias("method"))


@query(f"""WITH {TASKS} SELECT platform, substr(sha256('{START}' || chr(10) || 'w' || chr(10) || 'c' || chr(10) || array_to_string(list_sort(list(task_id || '|' || source_type || '|' || url)), chr(10))), 1, 24) AS manifest_id, count(*) AS tasks FROM t GROUP BY platform""")
def manifest_ids(spark: SparkSession, d: str) -> DataFrame:
    return planning.manifest_ids(acquisition.tasks(routes(spark, d), "US", "P", START), START, "w", "c")


@query("""SELECT user_id::VARCHAR AS task_id, arg_max(event_type, (date_trunc('second', ts), event_id)) AS result, count(DISTINCT (date_trunc('second', ts), event_type, event_id % 3)) AS kept FROM events GROUP BY 1""")
def receipt_history(spark: SparkSession, d: str) -> DataFrame:
    """Receipts saved twice over, in two parts: the history holds each once, the last one checked is current."""
    from auditlake.sources import feeds

    e = table(spark, d, "events")
    at = F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = e.select(F.col("user_id").cast("string").alias("task_id"), at.alias("checked_at"), F.col("event_type").alias("result"), (F.col("event_id") % 3).alias("part"), F.col("event_id"))
    path = f"{common.shared_dir(spark)}/receipts-{uuid.uuid4().hex}"
    plain = rows.drop("event_id")
    for some in (rows.filter("event_id % 2 = 0").drop("event_id"), plain):
        feeds.save_receipts(some, path)
    held = spark.read.parquet(path).groupBy("task_id").agg(F.count("*").alias("kept"))
    # of receipts of one second the last event's counts, as the SQL has it
    last = common.best_of(rows, ["task_id"], F.desc("checked_at"), F.desc("event_id")).select("task_id", "checked_at", "result", "part")
    now = feeds.current_receipts(spark, path).select("task_id", F.col("checked_at").alias("at"))
    return last.join(now, "task_id").filter("at = checked_at").join(held, "task_id").select("task_id", "result", "kept")


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''")
def content_store(spark: SparkSession, d: str) -> DataFrame:
    """Texts put into a store by their hash, twice, and got back by reference."""
    from auditlake.sources import feeds

    docs = table(spark, d, "documents").filter("text <> ''")
    rows = docs.select("doc_id", F.col("text").alias("body"), ids.hashed(F.col("text")).alias("content_hash"))
    rows = rows.withColumn("content_ref", F.concat(F.substring("content_hash", 1, 2), F.lit("/"), "content_hash"))
    path = f"{common.shared_dir(spark)}/contents-{uuid.uuid4().hex}"
    feeds.store_contents(rows.filter("doc_id % 2 = 0"), path)
    feeds.store_contents(rows, path, spark.read.parquet(path))
    got = feeds.read_contents(spark, path, rows.select("content_ref"))
    return rows.select("doc_id", "content_ref").join(got, "content_ref").select("doc_id", F.col("body").alias("text"))


# -- reports -------------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderstatus = 'P' AS watch, o_orderstatus <> 'P' AND left(o_orderpriority, 1) IN ('1', '2') AS key_action, count(*) AS n FROM orders GROUP BY ALL""")
def report_sections(spark: SparkSession, d: str) -> DataFrame:
    """Watch list, main list and key actions."""
    from auditlake.plans import report

    p = F.substring("o_orderpriority", 1, 1)
    level = F.when(p == "1", "high").when(p == "2", "medium").when(p == "3", "low").otherwise("watch")
    rows = table(spark, d, "orders").select(level.alias("level"), F.when(F.col("o_orderstatus") == "P", "unconfirmed").otherwise("new").alias("status"))
    return report.sections(rows).groupBy("watch", "key_action").agg(F.count("*").alias("n"))


@query("""WITH l(disposition) AS (VALUES ('duplicate_removed'), ('material_update'), ('operational_refresh'), ('review_required')), c AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'duplicate_removed' WHEN 'O' THEN 'material_update' ELSE 'review_required' END AS disposition, count(*) AS n FROM orders GROUP BY 1)
SELECT disposition, coalesce(n, 0)::BIGINT AS n FROM l LEFT JOIN c USING (disposition)""")
def disposition_counts(spark: SparkSession, d: str) -> DataFrame:
    from auditlake.plans import report

    kind = F.when(F.col("o_orderstatus") == "F", "duplicate_removed").when(F.col("o_orderstatus") == "O", "material_update").otherwise("review_required")
    return report.disposition_counts(table(spark, d, "orders").select(kind.alias("disposition")))


@query(CHAIN + " SELECT page_key, snapshot_id, previous_snapshot_id, change_status FROM chain")
def recaptured_pages(spark: SparkSession, d: str) -> DataFrame:
    """Captures that repeat the one before, id and hash, are the same record: the chain is that of the captures alone."""
    once = captures(spark, d)
    again = once.filter(F.col("event_id") % 3 == 0)
    return snapshots.chain(once.unionByName(again).unionByName(again)).select("page_key", "snapshot_id", "previous_snapshot_id", "change_status")


# -- calibration and worksheets ------------------------------------------------------------------------------------------

PICKED = """, t AS (SELECT w.i::INT AS watch, l.i::INT AS low, m.i::INT AS medium FROM range(10) w(i), range(10) l(i), range(10) m(i) WHERE w.i < l.i AND l.i < m.i),
h AS (SELECT score, level, count(*) AS n FROM c WHERE level IS NOT NULL GROUP BY ALL),
p AS (SELECT watch, low, medium, level, n, CASE WHEN score <= watch THEN 'watch' WHEN score <= low THEN 'low' WHEN score <= medium THEN 'medium' ELSE 'high' END AS predicted FROM t, h),
x AS (SELECT watch, low, medium, k, sum(CASE WHEN level = k AND predicted = k THEN n ELSE 0 END) AS tp, sum(CASE WHEN level = k THEN n ELSE 0 END) + sum(CASE WHEN predicted = k THEN n ELSE 0 END) AS either FROM p, (VALUES ('watch'), ('low'), ('medium'), ('high')) l(k) GROUP BY ALL),
f AS (SELECT watch, low, medium, k, tp, CASE WHEN either > 0 THEN 2.0 * tp / either ELSE 0 END AS f1 FROM x),
m AS (SELECT watch, low, medium, sum(tp)::BIGINT AS correct, round(((max(f1) FILTER (k = 'watch') + max(f1) FILTER (k = 'low')) + max(f1) FILTER (k = 'medium') + max(f1) FILTER (k = 'high')) / 4, 4) AS macro_f1 FROM f GROUP BY ALL)"""


@query(CONSENSUS + PICKED + " SELECT watch, low, medium, correct, macro_f1, row_number() OVER (ORDER BY macro_f1 DESC, correct DESC, abs(watch - 1) + abs(low - 4) + abs(medium - 7), watch, low, medium)::INT AS rank FROM m")
def threshold_ranking(spark: SparkSession, d: str) -> DataFrame:
    """All triples with macro F1 and rank, by which the candidate is chosen."""
    hist = calibration.histogram(calibration.consensus(reviews(spark, d)))
    return calibration.grid_search(hist).select("watch", "low", "medium", F.col("correct").cast("long").alias("correct"), "macro_f1", "rank")


@query("SELECT l_orderkey AS event_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1")
def unequal_breakdowns(spark: SparkSession, d: str) -> DataFrame:
    """Events whose reviewers gave unlike breakdowns."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.struct("l_returnflag", "l_linestatus").alias("score_breakdown"))
    return calibration.unequal_breakdowns(rows)


@query("""WITH s AS (SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 2) AS price FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1), f AS (SELECT n::DOUBLE AS n, price FROM s WHERE o_orderstatus = 'F'), o AS (SELECT n::DOUBLE AS n, price FROM s WHERE o_orderstatus = 'O')
SELECT 'n' AS metric, f.n AS current, o.n AS previous, round(f.n - o.n, 4) AS delta FROM f, o UNION ALL SELECT 'price', f.price, o.price, round(f.price - o.price, 4) FROM f, o""")
def calibration_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Two one-row reports compared metric by metric."""
    one = lambda s: table(spark, d, "orders").filter(F.col("o_orderstatus") == s).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("price"))
    return calibration.compare_reports(one("F"), one("O"), ("n", "price"))


#: Outcomes of a merge by the order's number modulo 10, and the number of dimensions that are kept.
OUTCOMES = ("new_unscored", "existing_score_conflict_requires_review", "evidence_changed_requires_review", "reviewed_level_changed_requires_review", "preserved_via_semantic_alias", "preserved_legacy_score", "preserved_blank", "preserved_partial", "preserved_complete", "retained_existing_only")


def _worksheets(spark: SparkSession, d: str) -> DataFrame:
    """Fresh and reviewed worksheets of orders that meet in each of ten ways, merged."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 10).cast("int").alias("k"), F.concat(F.lit("e"), _text("o_orderkey")).alias("event_id"))
    dims = lambda n: F.struct(*[F.when(F.lit(i) < n, F.lit(1)).alias(x) for i, x in enumerate(K.BREAKDOWN)])
    nobody = _array()
    alias = F.array(F.concat(F.lit("a"), "event_id"))
    print_of = ids.hashed(F.col("event_id"))
    fresh = o.filter("k <> 9").select(
        "pos", "event_id", F.when(F.col("k") == 4, alias).otherwise(nobody).alias("semantic_aliases"), F.lit("high").alias("reviewed_level"), dims(F.lit(0)).alias("score_breakdown"), F.lit(None).cast("int").alias("score"), print_of.alias("review_fingerprint"),
    )
    given = F.when(F.col("k") == 6, 0).when(F.col("k") == 7, 2).otherwise(5)
    old = o.filter("k <> 0").select(
        "pos", F.when(F.col("k") == 4, F.concat(F.lit("a"), "event_id")).otherwise(F.col("event_id")).alias("event_id"), nobody.alias("semantic_aliases"), F.when(F.col("k") == 3, "low").otherwise("high").alias("reviewed_level"), dims(given).alias("score_breakdown"),
        F.when(given == 5, 5).alias("score"), F.when(F.col("k") == 2, "x").when(F.col("k") != 5, print_of).alias("review_fingerprint"), "k",
    )
    second = old.filter("k = 1").withColumn("pos", F.col("pos") + 1_000_000_000).withColumn("score", F.lit(4))
    return worksheet.merge(fresh, old.unionByName(second).drop("k"))


@query("SELECT [" + ", ".join(f"'{x}'" for x in OUTCOMES) + "][o_orderkey % 10 + 1] AS merge_status, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'preserved_blank', 0 WHERE false")
def worksheet_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """All ten ways in which fresh and reviewed records can meet."""
    return _worksheets(spark, d).groupBy("merge_status").agg(F.count("*").alias("n"))


CATEGORIES = ("new_unscored", "score_conflicts", "reset_changed", "reset_changed", "preserved_complete", "preserved_complete", "preserved_partial", "preserved_partial", "preserved_complete", "retained_existing_only")


@query("SELECT [" + ", ".join(f"'{x}'" for x in CATEGORIES) + """][o_orderkey % 10 + 1] AS category, count(*) AS n, min('e' || o_orderkey) AS first, (SELECT count(*) FROM orders WHERE o_orderkey % 10 < 4) AS blockers, false AS ready FROM orders GROUP BY 1""")
def worksheet_diff(spark: SparkSession, d: str) -> DataFrame:
    """Categories of a merged worksheet, and whether it may be calibrated from."""
    return worksheet.diff_summary(_worksheets(spark, d)).select("category", "n", "first", "ready", "blockers")


@query("""WITH k AS (SELECT o_orderkey % 10 AS k FROM orders) SELECT count(*) AS record_count, count(*) FILTER (k IN (4, 5, 8, 9)) AS completed_score_breakdown_count, count(*) FILTER (k NOT IN (4, 5, 8, 9)) AS pending_score_breakdown_count,
  count(*) FILTER (k = 9) AS retained_existing_only_count, count(*) FILTER (k = 0) AS new_unscored_count, count(*) FILTER (k BETWEEN 4 AND 8) AS preserved_count, count(*) AS high FROM k""")
def worksheet_stats(spark: SparkSession, d: str) -> DataFrame:
    out = worksheet.sample_stats(_worksheets(spark, d))
    return out.select("*", F.col("reviewed_level_distribution")["high"].alias("high")).drop("reviewed_level_distribution")


@query("""WITH f AS (SELECT o_custkey AS key, o_orderkey AS pos FROM orders WHERE o_orderkey % 2 = 0), e AS (SELECT o_custkey AS key, min(o_orderkey) AS pos FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey NOT IN (SELECT key FROM f) GROUP BY 1)
SELECT key, pos FROM f UNION ALL SELECT key, pos FROM e""")
def merged_audit_entries(spark: SparkSession, d: str) -> DataFrame:
    """All fresh entries, and the first existing one of every other key."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("pos"))
    return worksheet.merged_entries(rows.filter("pos % 2 = 0"), rows.filter("pos % 2 = 1"), "key")


@query("""SELECT c_custkey, array_to_string(CASE WHEN c_custkey % 3 = 0 THEN [c_mktsegment, 'x'] WHEN c_mktsegment = 'BUILDING' THEN ['x', 'BUILDING'] ELSE ['x', 'BUILDING', c_mktsegment] END, ',') AS runs FROM customer""")
def merged_run_lists(spark: SparkSession, d: str) -> DataFrame:
    left = F.when(F.col("c_custkey") % 3 != 0, F.array(F.lit("x"), F.lit("BUILDING"), F.lit("x")))
    right = F.when(F.col("c_custkey") % 3 == 0, F.array(F.col("c_mktsegment"), F.lit("x"))).otherwise(F.array("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(worksheet.merged_runs(left, right), ",").alias("runs"))


@query("""SELECT user_id AS event_id, event_id AS pos FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 12 DESC, event_id DESC) = 1""")
def last_observations(spark: SparkSession, d: str) -> DataFrame:
    """The observation of an event's last run wins."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("event_id"), (F.col("event_id") % 12).alias("run_pos"), F.col("event_id").alias("pos"))
    return worksheet.last_observations(rows).select("event_id", "pos")


@query("""WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS pos, l_partkey % 50 AS a, l_suppkey % 50 AS b FROM lineitem WHERE l_linestatus = 'O'), r AS (SELECT pos, least(a // 2, b // 2) AS l, greatest(a // 2, b // 2) AS r FROM p WHERE a // 2 <> b // 2)
SELECT l AS "left", r AS "right", min(pos) AS pos FROM r GROUP BY ALL""")
def semantic_review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that wait for a review, by the roots of their clusters, each once whatever its direction."""
    pairs = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), (F.col("l_partkey") % 50).alias("a"), (F.col("l_suppkey") % 50).alias("b"), F.when(F.col("l_linestatus") == "O", "review_required").otherwise("automatic_duplicate").alias("decision"), F.lit(0.75).alias("confidence"))
    roots = spark.range(50).select(F.col("id").alias("event"), F.floor(F.col("id") / 2).alias("canonical"))
    return worksheet.review_queue(pairs, roots).select("left", "right", "pos")


# -- evaluation ----------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT doc_id FROM documents WHERE n_chars > 600), g AS (SELECT doc_id FROM labels WHERE quality = 1)
SELECT (SELECT array_to_string(list_sort(list(doc_id)), ',') FROM p WHERE doc_id NOT IN (SELECT doc_id FROM g)) AS false_positives, (SELECT array_to_string(list_sort(list(doc_id)), ',') FROM g WHERE doc_id NOT IN (SELECT doc_id FROM p)) AS false_negatives""")
def evaluation_errors(spark: SparkSession, d: str) -> DataFrame:
    """Ids of errors in order."""
    p, g = predictions(spark, d)
    out = evaluation.counts(evaluation.matched(p, g))
    return out.select(F.array_join(F.col("false_positive_ids").cast("array<string>"), ",").alias("false_positives"), F.array_join(F.col("false_negative_ids").cast("array<string>"), ",").alias("false_negatives"))


@query("""SELECT (c_nationkey % 4)::VARCHAR AS run, array_to_string(list(c_custkey ORDER BY c_custkey % 97, c_custkey), ',') AS error_ids FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1""")
def deduplication_errors(spark: SparkSession, d: str) -> DataFrame:
    """Ids of wrong deduplication cases, in the order of the cases."""
    c = table(spark, d, "customer").select((F.col("c_nationkey") % 4).cast("string").alias("run"), F.col("c_custkey").alias("current_id"), (F.col("c_custkey") % 97 * 1_000_000 + F.col("c_custkey")).alias("pos"))
    cases = c.select("run", "current_id", F.lit(0).alias("previous_id"), F.lit("material_update").alias("expected_disposition"), "pos")
    found = c.filter("current_id % 3 <> 0").select("run", "current_id", F.lit(0).alias("previous_id"), F.lit("material_update").alias("disposition"), "pos")
    out = evaluation.case_errors(evaluation.case_outcomes(cases, found), cases)
    return out.select("run", F.array_join(F.col("error_ids").cast("array<string>"), ",").alias("error_ids"))


RECORD = {"event_id": "e1", "should_include": True, "accepted_primary_source_urls": ["https://x.org/"], "status": "new", "level": "low", "published_date": "2026-07-01", "effective_date": None}
LABELS = {"dataset_version": 1, "dataset_name": "d", "review_status": "independently_reviewed", "reviewed_by": "r", "reviewed_at": faults.AT, "records": [RECORD, {"event_id": "e2", "should_include": False}], "deduplication_cases": [{"current_id": "a", "previous_id": "b", "expected_disposition": "c"}]}
LABEL_FAULTS: list[faults.Fault] = [
    ({}, []),
    ({"dataset_version": 2}, [("dataset_version", "must be 1")]),
    ({"dataset_name": " "}, [("dataset_name", "must be nonblank")]),
    ({"review_status": "done"}, [("review_status", "is not a known status")]),
    ({"reviewed_by": ""}, [("reviewed_by", "is required after a review")]),
    ({"reviewed_at": "2026-07-01"}, [("reviewed_at", faults.INSTANT)]),
    ({"review_status": "draft", "reviewed_by": faults.GONE, "reviewed_at": faults.GONE}, []),
    ({"records": []}, [("records", "must be a non-empty array")]),
    ({"records.1.event_id": "e1"}, [("records[1].event_id", "is a duplicate")]),
    ({"records.0.event_id": ""}, [("records[0].event_id", "must be nonblank")]),
    ({"records.1.should_include": "no"}, [("records[1].should_include", "must be boolean")]),
    ({"records.0.accepted_primary_source_urls": ["x"]}, [("records[0].accepted_primary_source_urls", "must be http(s) URLs")]),
    ({"records.0.status": "odd", "records.0.level": "odd"}, [("records[0].status", "is not a known status"), ("records[0].level", "is not a known level")]),
    ({"records.0.published_date": "1 July"}, [("records[0].published_date", "must be an ISO date or null")]),
    ({"deduplication_cases": "none"}, [("deduplication_cases", "must be an array")]),
    ({"deduplication_cases.0.previous_id": ""}, [("deduplication_cases[0].previous_id", "must be nonblank")]),
    ({"deduplication_cases": [LABELS["deduplication_cases"][0]] * 2}, [("deduplication_cases[1].current_id", "is a duplicate")]),
]


@query(faults.counted(LABEL_FAULTS))
def faults_label_sets(spark: SparkSession, d: str) -> DataFrame:
    """Label sets, each with one fault."""
    rows = faults.planted(spark, d, LABELS, LABEL_FAULTS)
    return faults.told(rows, evaluation.label_rules(rows.select("report", "raw")))


EVALUATED: list[faults.Fault] = [
    ({}, []),
    ({"events": {}}, [("events", "must be an array")]),
    ({"events.0.id": " "}, [("events[0].id", "must be nonblank")]),
    ({"events.1.id": "e1"}, [("events[1].id", "is a duplicate")]),
    ({"deduplication.matches": 5}, [("deduplication.matches", "must be an array")]),
    ({"deduplication.matches.0.current_id": ""}, [("deduplication.matches[0].current_id", "must be nonblank")]),
    ({"deduplication": faults.GONE}, []),
]


@query(faults.counted(EVALUATED))
def faults_evaluated_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports that cannot be evaluated, each with one fault."""
    rows = faults.planted(spark, d, {"events": [{"id": "e1"}, {"id": "e2"}], "deduplication": {"matches": [{"current_id": "e1"}]}}, EVALUATED)
    return faults.told(rows, evaluation.report_rules(rows.select("report", "raw")))


# -- links and clusters whose similarities are plain ---------------------------------------------------------------------

@query(SQL["library_search"])
def library_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The search of ``library_search`` over a store that two ingests have filled, by its index; the second replaces what the first had wrong."""
    docs = table(spark, d, "documents")
    day = F.concat(F.lit("2026-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    rows = docs.select(F.col("doc_id").cast("string").alias("event_id"), day.alias("report_date"), day.alias("cutoff"), F.concat_ws("/", day, (F.col("doc_id") % 2).cast("string")).alias("report_key"), F.col("lang").alias("title"), F.col("text").alias("summary"))
    store = f"{common.shared_dir(spark)}/library-{uuid.uuid4().hex}"
    stale = rows.filter("report_key like '%/1'").withColumn("summary", F.lit("onthe first try"))
    for part in (rows.filter("report_key like '%/0'").unionByName(stale), rows.filter("report_key like '%/1'")):
        library_index.append(spark, store, part.select("report_key", "report_date", "cutoff").distinct(), part, library.SEARCHED)
    return library.find(spark, store, "onthe", 20).select("event_id", "last_seen")


# -- stored captures with planted faults -----------------------------------------------------------------------------------

#: Records, index and diffs of the captures' store: lost predecessors, rings, wrong hashes, and diffs and latest pointers that are lost or wrong.
STORE = f"""WITH RECURSIVE {CAPTURES}, o AS (SELECT page_key, event_id, snapshot_id, captured_at, 'v' || content_hash AS content, lag(snapshot_id) OVER w AS p, lag('v' || content_hash) OVER w AS pc,
  first_value(snapshot_id) OVER w AS first_id, last_value(snapshot_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id, split_part(page_key, '/', 1)::BIGINT AS user_id
  FROM captures WINDOW w AS (PARTITION BY page_key ORDER BY captured_at, snapshot_id)),
r AS (SELECT page_key, snapshot_id, captured_at, content, CASE WHEN p IS NULL THEN CASE WHEN event_id % 5 = 0 THEN last_id END WHEN event_id % 97 = 0 THEN 'gone' ELSE p END AS prev,
  CASE WHEN event_id % 89 = 0 THEN 'bad' ELSE sha256(content) END AS content_hash, CASE WHEN p IS NULL THEN 'first_seen' WHEN pc = content THEN 'unchanged' ELSE 'changed' END AS change_status FROM o),
d AS (SELECT page_key, CASE WHEN event_id % 1009 = 0 THEN 'x' ELSE '' END || snapshot_id AS snapshot_id,
  CASE WHEN pc <> content THEN '--- previous' || chr(10) || '+++ current' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-' || pc || chr(10) || '+' || content || chr(10) ELSE '' END || CASE WHEN event_id % 73 = 0 THEN '#' ELSE '' END AS diff
  FROM o WHERE (pc <> content AND event_id % 83 <> 0) OR (pc = content AND event_id % 79 = 0)),
i AS (SELECT DISTINCT page_key, CASE WHEN user_id % 50 = 0 THEN 'gone' WHEN user_id % 51 = 0 THEN first_id ELSE last_id END AS latest FROM o WHERE user_id % 53 <> 0)"""


def stored_captures(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, index and diffs of a store over all events."""
    rows = captures(spark, d).withColumn("content", F.concat(F.lit("v"), F.col("content_hash").cast("string")))
    order = Window.partitionBy("page_key").orderBy("captured_at", "snapshot_id")
    rows = rows.withColumn("p", F.lag("snapshot_id").over(order)).withColumn("pc", F.lag("content").over(order)).withColumn("user_id", F.split("page_key", "/")[0].cast("long"))
    ends = rows.groupBy("page_key").agg(F.min_by("snapshot_id", F.struct("captured_at", "snapshot_id")).alias("first_id"), F.max_by("snapshot_id", F.struct("captured_at", "snapshot_id")).alias("last_id"), F.first("user_id").alias("user_id"))
    e, last, alike = F.col("event_id"), rows.join(ends.select("page_key", "last_id"), "page_key"), F.col("pc") == F.col("content")
    records = last.select(
        "page_key", "snapshot_id", "captured_at", "content", F.when(F.col("p").isNull(), F.when(e % 5 == 0, F.col("last_id"))).when(e % 97 == 0, "gone").otherwise(F.col("p")).alias("previous_snapshot_id"),
        F.when(e % 89 == 0, "bad").otherwise(ids.hashed(F.col("content"))).alias("content_hash"), F.when(F.col("p").isNull(), "first_seen").when(alike, "unchanged").otherwise("changed").alias("change_status"),
    )
    diff = F.when(alike, "").otherwise(F.concat(F.lit("--- previous\n+++ current\n@@ -1 +1 @@\n-"), "pc", F.lit("\n+"), "content", F.lit("\n")))
    diffs = rows.filter((~alike & (e % 83 != 0)) | (alike & (e % 79 == 0))).select("page_key", F.concat(F.when(e % 1009 == 0, "x").otherwise(""), "snapshot_id").alias("snapshot_id"), F.concat(diff, F.when(e % 73 == 0, "#").otherwise("")).alias("diff"))
    u = F.col("user_id")
    index = ends.filter(u % 53 != 0).select("page_key", F.when(u % 50 == 0, "gone").when(u % 51 == 0, F.col("first_id")).otherwise(F.col("last_id")).alias("latest_snapshot_id"))
    return records, index, diffs


@query(STORE + """, reach AS (SELECT i.page_key, latest AS id FROM i JOIN r ON r.page_key = i.page_key AND r.snapshot_id = latest
  UNION SELECT reach.page_key, b.snapshot_id FROM reach JOIN r ON r.page_key = reach.page_key AND r.snapshot_id = id JOIN r b ON b.page_key = r.page_key AND b.snapshot_id = r.prev),
ring AS (SELECT page_key FROM r GROUP BY page_key HAVING count(*) FILTER (prev = 'gone') = 0 AND count(*) FILTER (prev IS NULL) = 0),
m AS (SELECT r.*, b.captured_at AS earlier, CASE WHEN b.content_hash = r.content_hash THEN 'unchanged' ELSE 'changed' END AS status, b.content AS before FROM r JOIN r b ON b.page_key = r.page_key AND b.snapshot_id = r.prev),
c AS (SELECT * FROM m WHERE status = 'changed')
SELECT page_key, snapshot_id, 'cycle' AS fault FROM r SEMI JOIN ring USING (page_key)
UNION ALL SELECT page_key, snapshot_id, 'missing_previous' FROM r WHERE prev = 'gone'
UNION ALL SELECT page_key, snapshot_id, 'unreachable' FROM r WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.page_key = r.page_key AND id = snapshot_id)
UNION ALL SELECT page_key, snapshot_id, 'not_chronological' FROM m WHERE captured_at <= earlier
UNION ALL SELECT page_key, snapshot_id, 'wrong_status' FROM m WHERE change_status <> status
UNION ALL SELECT page_key, snapshot_id, 'wrong_hash' FROM r WHERE content_hash = 'bad'
UNION ALL SELECT page_key, snapshot_id, 'missing_diff' FROM c ANTI JOIN d USING (page_key, snapshot_id)
UNION ALL SELECT c.page_key, c.snapshot_id, 'wrong_diff' FROM c JOIN d USING (page_key, snapshot_id)
  WHERE diff <> CASE WHEN before = content THEN '' ELSE '--- previous' || chr(10) || '+++ current' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-' || before || chr(10) || '+' || content END || chr(10)
UNION ALL SELECT page_key, snapshot_id, 'unexpected_diff' FROM d SEMI JOIN r USING (page_key, snapshot_id) ANTI JOIN c USING (page_key, snapshot_id)
UNION ALL SELECT page_key, snapshot_id, 'unreferenced_diff' FROM d ANTI JOIN r USING (page_key, snapshot_id)
UNION ALL SELECT DISTINCT page_key, NULL, 'no_index' FROM r ANTI JOIN i USING (page_key)
UNION ALL SELECT page_key, NULL, 'latest_missing' FROM i WHERE latest = 'gone'
UNION ALL SELECT DISTINCT i.page_key, NULL, 'latest_stale' FROM i JOIN r ON r.page_key = i.page_key AND r.prev = latest AND latest <> 'gone'""")
def chain_pointer_audit(spark: SparkSession, d: str) -> DataFrame:
    """Every planted fault of the store, found by following its pointers."""
    return chains.audited(*stored_captures(spark, d))


@query(STORE + """, f AS (SELECT r.page_key, r.snapshot_id, captured_at, NOT EXISTS (SELECT 1 FROM r x WHERE x.page_key = r.page_key AND x.prev = r.snapshot_id) AS tail FROM r),
t AS (SELECT page_key, arg_max(snapshot_id, (tail, captured_at, snapshot_id)) AS last FROM f GROUP BY page_key)
SELECT t.page_key, coalesce(nullif(latest, 'gone'), last) AS latest_snapshot_id, coalesce(latest, 'gone') = 'gone' AS recovered FROM t LEFT JOIN i USING (page_key)""")
def latest_recovered(spark: SparkSession, d: str) -> DataFrame:
    """The latest capture of each page, from its records where the index lacks it or names none."""
    records, index, _ = stored_captures(spark, d)
    return chains.repaired(index, records)


#: Texts of one letter: two of them are equal or have nothing in common.
LETTERS = "repeat(chr((97 + {0} % 3)::INT), 12)"


@query(f"""WITH e AS (SELECT c_custkey AS pos, c_nationkey % 5 AS j, {LETTERS.format("c_custkey")} AS title, c_mktsegment AS authority, c_custkey // 2 % 2 AS u FROM customer),
s AS (SELECT a.pos AS ci, b.pos AS pi, a.j IS NOT DISTINCT FROM b.j AS jj, a.title = b.title AS t, a.authority = b.authority AS s, a.u = b.u AS u FROM e a JOIN e b ON a.j = b.j AND a.pos % 2 = 0 AND b.pos % 2 = 1)
SELECT ci, pi, round((0.30 * t::INT + 0.12 * s::INT + 0.10 + 0.14 * u::INT) / 0.66, 6) AS score FROM s WHERE (t OR s) AND (0.30 * t::INT + 0.12 * s::INT + 0.10 + 0.14 * u::INT) / 0.66 >= 0.65""")
def weighted_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of events by the weighted mean of title, authority, jurisdiction and URL; authorities share no letters' order."""
    c = table(spark, d, "customer")
    title = F.repeat(F.char((F.lit(97) + F.col("c_custkey") % 3).cast("int")), 12)
    # a segment as one letter, so that unlike authorities have nothing in common
    segment = F.repeat(F.translate(F.substring("c_mktsegment", 1, 1), "ABFHM", "vwxyz"), 9)
    rows = c.select(
        F.col("c_custkey").alias("pos"), F.lit("").alias("id"), title.alias("title"), F.lit("").alias("summary"), F.lit("").alias("source_title"), segment.alias("authority"),
        F.concat(F.lit("j"), (F.col("c_nationkey") % 5).cast("string")).alias("jurisdiction"), _array().alias("products"), F.concat(F.lit("https://x.org/"), (F.floor(F.col("c_custkey") / 2) % 2).cast("string")).alias("source_url"),
    )
    out = linkage.score_pairs(rows.filter("pos % 2 = 0"), rows.filter("pos % 2 = 1"), digits=6)
    return out.select("ci", "pi", "score")


@query(f"""WITH e AS (SELECT c_custkey AS pos, c_nationkey AS j, c_custkey % 3 AS t, c_custkey * 7 // 5 % 4 AS u, c_custkey % 2 AS side FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY j, t, u, side ORDER BY pos) AS n FROM e),
same AS (SELECT c.pos AS ci, p.pos AS pi, 1.0::DOUBLE AS score FROM r c JOIN r p ON c.side = 0 AND p.side = 1 AND c.j = p.j AND c.t = p.t AND c.u = p.u AND c.n = p.n),
rest AS (SELECT *, row_number() OVER (PARTITION BY j, t, side ORDER BY pos) AS m FROM r WHERE NOT EXISTS (SELECT 1 FROM same WHERE pos IN (ci, pi)))
SELECT * FROM same UNION ALL SELECT c.pos, p.pos, round((0.30 + 0.10) / 0.54, 6) FROM rest c JOIN rest p ON c.side = 0 AND p.side = 1 AND c.j = p.j AND c.t = p.t AND c.m = p.m""")
def dedup_copies_match(spark: SparkSession, d: str) -> DataFrame:
    """Many copies on both sides: equal ones are paired by rank, and what is left with those of another URL, in two rounds."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        k.alias("pos"), F.lit("").alias("id"), F.repeat(F.char((F.lit(97) + k % 3).cast("int")), 12).alias("title"), F.lit("").alias("summary"), F.lit("").alias("source_title"), F.lit("").alias("authority"),
        F.concat(F.lit("j"), F.col("c_nationkey").cast("string")).alias("jurisdiction"), _array().alias("products"), F.concat(F.lit("https://x.org/"), (F.floor(k * 7 / 5) % 4).cast("string")).alias("source_url"),
    )
    return linkage.match_events(rows.filter("pos % 2 = 0"), rows.filter("pos % 2 = 1"), alone=0).select("ci", "pi", F.round("score", 6).alias("score"))


LADDER = f"""WITH e AS (SELECT c_custkey AS pos, {LETTERS.format("c_custkey // 4")} AS title, c_custkey % 3 AS a, c_custkey // 2 % 40 AS u, c_custkey % 7 AS n, c_custkey % 5 AS p FROM customer),
s AS (SELECT x.pos AS a, y.pos AS b, x.title = y.title AS t, x.a = y.a AS au, x.u = y.u AS url, x.n = y.n AS anchor, x.p = y.p AS pub FROM e x JOIN e y ON x.pos < y.pos AND (x.u = y.u OR (x.p = y.p AND x.n = y.n))),
l AS (SELECT a, b, CASE WHEN url AND au AND pub THEN 0.97 WHEN url AND au AND anchor AND t THEN 0.94 WHEN au AND pub AND anchor AND t THEN 0.96 WHEN url THEN 0.75 END::DOUBLE AS confidence, NOT (url AND au AND pub OR au AND anchor AND t AND (url OR pub)) AS ask FROM s)"""


def _laddered(spark: SparkSession, d: str) -> DataFrame:
    """Events whose titles are alike or not at all."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    letters = F.repeat(F.char((F.lit(97) + F.floor(k / 4) % 3).cast("int")), 12)
    day = F.concat(F.lit("2026-07-0"), (k % 5 + 1).cast("string"))
    return c.select(
        k.alias("pos"), letters.alias("title"), F.concat(F.lit("No "), (k % 7 + 50).cast("string")).alias("source_title"), F.lit("").alias("summary"),
        F.element_at(_array(F.lit("aaaa"), F.lit("bbbb"), F.lit("cccc")), (k % 3 + 1).cast("int")).alias("authority"), F.concat(F.lit("https://x.org/"), (F.floor(k / 2) % 40).cast("string")).alias("source_url"),
        day.alias("published_date"), F.lit("2026-08-01").alias("effective_date"),
    )


@query(LADDER + " SELECT a, b, CASE WHEN ask THEN 'review_required' ELSE 'automatic_duplicate' END AS decision, confidence FROM l WHERE confidence IS NOT NULL")
def semantic_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The ladder of rules over events whose titles are alike or not at all."""
    return discovery.semantic_links(_laddered(spark, d))


@query(LADDER.replace("WITH e", "WITH RECURSIVE e") + """, g AS (SELECT a, b FROM l WHERE confidence IS NOT NULL AND NOT ask), u AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
r AS (SELECT pos AS node, pos AS seen FROM e UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a) SELECT node AS pos, min(seen) AS canonical FROM r GROUP BY node""")
def semantic_canonicals(spark: SparkSession, d: str) -> DataFrame:
    """The canonical event of every event, over automatic duplicates."""
    return discovery.semantic_clusters(_laddered(spark, d))


LEADS = """WITH e AS (SELECT c_custkey AS pos, c_custkey // 3 AS u, c_nationkey % 4 AS j, c_custkey % 4 AS tier, c_custkey % 6 AS momentum, c_custkey % 40 AS age FROM customer),
s AS (SELECT *, CASE WHEN age * 12 <= 24 THEN 25 WHEN age * 12 <= 72 THEN 21 WHEN age * 12 <= 168 THEN 16 WHEN age * 12 <= 336 THEN 10 WHEN age * 12 <= 720 THEN 5 ELSE 0 END AS recency, [20, 14, 8, 5][tier + 1] AS quality, CASE WHEN j = 1 THEN 8 ELSE 0 END + 6 + 3 AS relevance FROM e),
g AS (SELECT u, j, max(recency) AS r, max(quality) AS q, max(momentum) AS m, max(relevance) AS b, count(*) AS n, min(pos) AS first FROM s GROUP BY u, j)"""


@query(LEADS + """, p AS (SELECT first, n, r + q + m + b AS priority FROM g) SELECT first, n, priority, priority >= 45 AS qualified, false AS weak_signal, dense_rank() OVER (ORDER BY priority DESC)::INT AS place FROM p""")
def lead_priorities(spark: SparkSession, d: str) -> DataFrame:
    """Leads of one page and jurisdiction make a cluster, whose best values make its priority; from 45 on it qualifies."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    at = F.date_format(F.lit("2026-07-21 00:00:00").cast("timestamp") - F.make_dt_interval(hours=(k % 40 * 12).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    unlike = F.sha2(k.cast("string").cast("binary"), 256)
    rows = c.select(
        k.alias("pos"), F.lpad(k.cast("string"), 9, "0").alias("lead_id"), F.lit("").alias("source_title"), F.concat(F.lit("https://x"), F.lit(".org/"), F.floor(k / 3).cast("string")).alias("source_url"),
        F.element_at(_array(*[F.lit(x) for x in ("official_lead", "trade_media", "seller_forum", "social")]), (k % 4 + 1).cast("int")).alias("source_tier"), at.alias("published_at"),
        F.concat(F.lit("j"), (F.col("c_nationkey") % 4).cast("string")).alias("jurisdiction"), F.lit("acme").alias("platform"), _array().alias("products"), _array().alias("hs_codes"), F.lit("").alias("claim"), (k % 6).cast("int").alias("momentum_score"), unlike.alias("u"),
    )
    out = discovery.prioritize(rows.drop("u"), "2026-07-21T00:00:00+00:00", regions=["j1"])
    out = out.select(F.col("lead_ids")[0].cast("long").alias("first"), F.size("lead_ids").cast("long").alias("n"), F.col("priority_score").cast("long").alias("priority"), "qualified", "weak_signal", "rank")
    # clusters of one priority are in the order of their ids, which are hashes: the place of the priority is compared
    firsts = out.groupBy("priority").agg(F.min("rank").alias("least"))
    places = common.placed(firsts, F.col("least")).select("priority", F.col("place").cast("int").alias("place"))
    return out.drop("rank").join(F.broadcast(places), "priority").select("first", "n", "priority", "qualified", "weak_signal", "place")


# -- libraries and files -------------------------------------------------------------------------------------------------


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n, user_id::VARCHAR AS event FROM events WHERE user_id = 7 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def drill_context(spark: SparkSession, d: str) -> DataFrame:
    """The last sighting of an event with how many there are."""
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").cast("string").alias("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("cutoff"), F.lpad(_text("event_id"), 12, "0").alias("report_date"), F.col("event_id").alias("own"))
    return library.drill_context(rows, "7").select(F.col("own").alias("event_id"), "n", F.col("event_id").alias("event"))


def _files(spark: SparkSession, texts: DataFrame) -> str:
    """Texts (key, raw) as JSON files in the shared folder, one a file, in a folder for each key."""
    path = f"{common.shared_dir(spark)}/files-{uuid.uuid4().hex}"
    texts.repartition(25, "key").withColumn("v", F.parse_json("raw")).select("key", F.col("v").cast("string").alias("value")).write.partitionBy("key").text(path)
    return path


def _named_json(spark: SparkSession, path: str) -> str:
    """The files with names that end in .json, as sources look for those."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    each = store.listFiles(fs, True)
    while each.hasNext():
        file = each.next().getPath()
        if file.getName().endswith(".txt"):
            store.rename(file, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(file.toString()).removesuffix(".txt") + ".json"))
    return path


def _key() -> Column:
    return F.regexp_extract("report", r"key=(\d+)", 1).cast("long").alias("key")


@query("""SELECT n_nationkey::BIGINT AS key, n_nationkey % 5 <> 0 AS valid, CASE WHEN n_nationkey % 5 <> 0 THEN 'e1' END AS event_id, CASE WHEN n_nationkey % 5 <> 0 THEN 'acme market' END AS platform, (n_nationkey % 5 = 0)::BIGINT AS violations FROM nation""")
def report_files(spark: SparkSession, d: str) -> DataFrame:
    """Reports read from a tree of files: broken ones are skipped and counted, events come with their policies."""
    from auditlake.sources import reports

    good, bad = json.dumps(faults.REPORT), faults.changed(faults.REPORT, {"timezone": faults.GONE})
    texts = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.when(F.col("n_nationkey") % 5 == 0, bad).otherwise(good).alias("raw"))
    raw = reports.raw(spark, _named_json(spark, _files(spark, texts)))
    valid, skipped = reports.split_valid(raw)
    rows = reports.events(valid).select(_key(), F.lit(True).alias("valid"), F.col("id").alias("event_id"), F.lower("policy.platform").alias("platform"), F.lit(0).cast("long").alias("violations"))
    return rows.unionByName(skipped.select(_key(), F.lit(False).alias("valid"), "violations"), allowMissingColumns=True)


@query("""SELECT n_nationkey::BIGINT AS key, 'r-' || i AS route_id, ['official_updates', 'current_policy', 'dashboard'][i + 1] AS source_type, (SELECT count(*) FROM nation) * 2 AS aliases FROM nation, range(3) t(i)""")
def registry_files(spark: SparkSession, d: str) -> DataFrame:
    """Platform files as routes and aliases."""
    from auditlake.sources import reports

    text_of = F.replace(F.replace(F.lit(json.dumps(faults.PLATFORM)), F.lit('"acme"'), F.concat(F.lit('"p'), _text("n_nationkey"), F.lit('"'))), F.lit('"Acme"'), F.concat(F.lit('"P '), _text("n_nationkey"), F.lit('"')))
    path = _named_json(spark, _files(spark, table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), text_of.alias("raw"))))
    found, aliases = reports.registry(spark, path)
    return found.select(F.substring_index("platform", " ", -1).cast("long").alias("key"), "route_id", "source_type", F.lit(aliases.count()).cast("long").alias("aliases"))


@query("SELECT n_nationkey::BIGINT AS key, 's' || n_nationkey AS id, 'https://x.org/' AS url FROM nation")
def official_source_files(spark: SparkSession, d: str) -> DataFrame:
    from auditlake.sources import reports

    raw = F.replace(F.lit(json.dumps({"sources": [faults.SOURCE]})), F.lit('"s1"'), F.concat(F.lit('"s'), _text("n_nationkey"), F.lit('"')))
    path = _named_json(spark, _files(spark, table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), raw.alias("raw"))))
    return reports.official_sources(spark, path).select(F.substring("id", 2, 9).cast("long").alias("key"), "id", "url")


@query("""SELECT n_nationkey::BIGINT AS key, n_name AS name, (1000 + n_nationkey)::VARCHAR AS code, 0 AS markets FROM nation""")
def catalog_files(spark: SparkSession, d: str) -> DataFrame:
    """Catalogs as items; separators leave codes, missing lists are empty."""
    from auditlake.sources import reports

    code = F.concat(F.substring((F.col("n_nationkey") + 1000).cast("string"), 1, 2), F.lit("."), F.substring((F.col("n_nationkey") + 1000).cast("string"), 3, 2))
    raw = F.concat(F.lit('{"schema_version":"1.0","organization":"o","items":[{"sku":"'), _text("n_nationkey"), F.lit('","name":"'), "n_name", F.lit('","hs_codes":["'), code, F.lit('"]}]}'))
    path = _named_json(spark, _files(spark, table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), raw.alias("raw"))))
    return reports.catalog(spark, path).select(F.col("sku").cast("long").alias("key"), "name", F.col("hs_codes")[0].alias("code"), F.size("markets").alias("markets"))


@query("""SELECT n_nationkey::BIGINT AS key, ['manifest', 'receipt'][n_nationkey % 3 + 1] AS kind FROM nation WHERE n_nationkey % 3 < 2""")
def run_artefacts(spark: SparkSession, d: str) -> DataFrame:
    """Files of a run told apart by their keys; others are left."""
    from auditlake.sources import reports

    raw = F.element_at(F.array(F.lit('{"manifest_id":"m","tasks":[]}'), F.lit('{"task_id":"t","result":"blocked","checked_at":"x"}'), F.lit('{"other":1}')), (F.col("n_nationkey") % 3 + 1).cast("int"))
    path = _named_json(spark, _files(spark, table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), raw.alias("raw"))))
    manifests, found = reports.run_artefacts(spark, path)
    return manifests.select(_key(), F.lit("manifest").alias("kind")).union(found.select(_key(), F.lit("receipt").alias("kind")))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'not_a_feed' WHEN page_id % 4 = 1 THEN 'too_large' WHEN page_id % 4 = 2 THEN 'missing' END AS reason, CASE WHEN page_id % 4 = 3 THEN 'https://x.org/' || page_id END AS url FROM pages""")
def sitemaps_and_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Sitemaps give entries; what is no feed, too large or missing is told with its reason."""
    from auditlake.sources import feeds

    k = F.col("page_id") % 4
    good = F.concat(F.lit("<urlset><url><loc>https://x.org/"), _text("page_id"), F.lit("</loc></url></urlset>"))
    content = F.when(k == 0, F.lit("<broken")).when(k == 1, F.rpad(F.lit("<rss>"), K.XML_LIMIT + 1, " ")).when(k == 3, good)
    rows = table(spark, d, "pages").select("page_id", content.alias("content"))
    told = feeds.refused(rows).select("page_id", "reason", _none().alias("url"))
    return told.unionByName(feeds.entries(rows.filter(k != 1)).select("page_id", _none().alias("reason"), "url"))
