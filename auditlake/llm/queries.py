"""The thirteen operators as queries over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import chat, decontam, filter_audit, html_extract, lexical, media, mixing, quality, secrets, simhash, topk, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- 1 ---------------------------------------------------------------------------------------------------------------


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


# -- 2 ---------------------------------------------------------------------------------------------------------------

# The rules of the query.
URL_RULES = tuple(
    url_filter.parse_rule(text, verdict)
    for text, verdict in (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = """
WITH rests AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests
), rules(rhost, rpath, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict
  FROM parts LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(coalesce(rule, '')) DESC) = 1
"""

# -- 3 ---------------------------------------------------------------------------------------------------------------


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


# -- 4 ---------------------------------------------------------------------------------------------------------------


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


# -- 5 ---------------------------------------------------------------------------------------------------------------

#: Integer weights by level; other values weigh 1.
MIX_WEIGHTS = {
    "domain": {"web": 40, "books": 45, "code": 10, "other": 5},
    "lang": {"en": 55, "fr": 15, "de": 15, "es": 15},
    "source": {"src0": 3},
}
#: The budget: three fifths of the corpus's tokens, each document at most twice.
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (3, 5), 2, "mix"


def domain_of(source: str = "source"):
    """The synthetic sources' domains, by the form of their names."""
    c = F.col(source)
    return F.when(c.rlike("^src[0-9]$"), "web").when(c.rlike("^src1[0-4]$"), "books").when(c.rlike("^src1[5-9]$"), "code").otherwise("other")


def mixture(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, MIX_WEIGHTS, domain_of(), MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixture(docs).select("doc_id", "domain", "lang", "source", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("epoch").cast("int").alias("epoch"))


def _level_sql(level: str, upper: list[str], number: int) -> str:
    """One level of the budgets: children filled in order of capacity by weight."""
    given = MIX_WEIGHTS[level]
    weight = f"CASE {level} " + " ".join(f"WHEN '{v}' THEN {w}" for v, w in given.items()) + " ELSE 1 END"
    node = ", ".join([*upper, level])
    family = f"PARTITION BY {', '.join(upper) or '1'}"
    order = f"({family} ORDER BY cap::DOUBLE / w, {level}"
    return f"""
n{number} AS (SELECT {node}, sum(cap0) AS cap, max(budget) AS total, max({weight})::HUGEINT AS w FROM p{number} GROUP BY {node}),
o{number} AS (SELECT *, total - coalesce(sum(cap) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
       sum(w) OVER {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM n{number}),
f{number} AS (SELECT *, cap * rest_w <= w * remaining AS is_full FROM o{number}),
s{number} AS (SELECT *, total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({family}) AS open,
       greatest(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({family}), 1) AS open_w FROM f{number}),
g{number} AS (SELECT {node}, CASE WHEN is_full THEN cap ELSE least(cap, (w * open) // open_w) END AS given FROM s{number}),
p{number + 1} AS (SELECT p{number}.* REPLACE (given AS budget) FROM p{number} JOIN g{number} USING ({node})),"""


OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS own, lang, source, coalesce(lang, '(none)') AS l, coalesce(source, '(none)') AS s,
         CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' WHEN regexp_matches(source, '^src1[0-4]$') THEN 'books'
              WHEN regexp_matches(source, '^src1[5-9]$') THEN 'code' ELSE 'other' END AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::HUGEINT AS n FROM documents
), leaf AS (SELECT domain, l AS lang, s AS source, sum(n)::HUGEINT AS supply FROM d GROUP BY ALL),
p0 AS (SELECT *, supply * {MIX_EPOCHS} AS cap0,
       least((sum(supply) OVER ())::HUGEINT * {MIX_SHARE[0]} // {MIX_SHARE[1]}, (sum(supply) OVER ())::HUGEINT * {MIX_EPOCHS}) AS budget FROM leaf),
{_level_sql("domain", [], 0)}{_level_sql("lang", ["domain"], 1)}{_level_sql("source", ["domain", "lang"], 2)}
plan AS (SELECT domain, lang, source, supply, budget, CASE WHEN supply > 0 THEN least(budget // supply, {MIX_EPOCHS}) ELSE 0 END AS whole FROM p3),
ordered AS (
  SELECT d.*, whole, budget - whole * supply AS rest,
         sum(n) OVER (PARTITION BY d.domain, l, s ORDER BY md5('{MIX_SEED}:' || (whole + 1)::VARCHAR || ':' || own), n
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
  FROM d JOIN plan ON d.domain = plan.domain AND d.l = plan.lang AND d.s = plan.source
), times AS (SELECT *, (whole + CASE WHEN so_far <= rest THEN 1 ELSE 0 END)::INT AS times FROM ordered)
SELECT doc_id, domain, lang, source, n::BIGINT AS n_tokens, unnest(range(1, times + 1))::INT AS epoch FROM times WHERE times > 0
"""

# -- 6 ---------------------------------------------------------------------------------------------------------------

#: Seconds between a page's capture and the next, and the longest time until it is asked for again.
CAPTURE_EVERY, AGAIN_WITHIN = 60, 400_000


def records_of(pages: DataFrame) -> DataFrame:
    """Two records of every page: its response, and a later revisit with the response's validators."""
    at = F.col("page_id") * CAPTURE_EVERY
    digest = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    wait = F.conv(F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 7), 16, 10).cast("long") % AGAIN_WITHIN
    tag = F.concat(F.lit('"'), digest, F.lit('"'))
    text = lambda c: c.cast("string")
    stored = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), text(F.char_length(F.coalesce("html", F.lit("")))), F.lit("date"), text(at), F.lit("etag"), tag)
    renewed = F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), text(at + 1 + wait), F.lit("cache-control"), F.lit("max-age=60"), F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("server"), F.lit("crawl"))
    none = F.lit(None).cast("string")
    response = pages.select((F.col("page_id") * 2).alias("record_id"), "url", at.alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), tag.alias("etag"), none.alias("last_modified"), stored.alias("headers"), F.col("html").alias("payload"))
    revisit = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (at + 1 + wait).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.concat(F.lit("W/"), tag).alias("etag"), none.alias("last_modified"), renewed.alias("headers"), none.alias("payload"))
    return response.unionByName(revisit)


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(records_of(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return found.select("record_id", "canonical_url", "outcome", "refers_to", shown.alias("headers"), F.sha2(F.col("payload").cast("binary"), 256).alias("payload_sha256"))


OP6_SQL = f"""
WITH p AS (
  SELECT page_id, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest,
         url, coalesce(html, '') AS html, md5(coalesce(html, '')) AS digest,
         ('0x' || substr(md5(coalesce(url, '')), 1, 7))::BIGINT % {AGAIN_WITHIN} AS wait, page_id * {CAPTURE_EVERY} AS at FROM pages
), q AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'),
                lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))) AS asked FROM p
), c AS (
  SELECT *, CASE WHEN trim(url) <> '' THEN
      regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^www\\.', ''), ':(80|443)$', '')
      || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/$', '')
      || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS canonical_url FROM q
), m AS (
  SELECT v.page_id, v.canonical_url, v.digest AS mine, v.at + 1 + v.wait AS ts, r.page_id AS prior, r.digest, r.html, r.at
  FROM c v LEFT JOIN c r ON v.canonical_url = r.canonical_url AND r.at < v.at + 1 + v.wait
  QUALIFY row_number() OVER (PARTITION BY v.page_id ORDER BY r.at DESC NULLS LAST, r.page_id DESC) = 1
)
SELECT page_id * 2 + 1 AS record_id, canonical_url,
       CASE WHEN prior IS NULL THEN 'no_prior' WHEN mine = digest THEN 'resolved' ELSE 'mismatch' END AS outcome,
       CASE WHEN mine = digest THEN prior * 2 END AS refers_to,
       CASE WHEN mine = digest THEN 'cache-control=max-age=60;content-length=' || length(html) || ';content-type=text/html;date=' || ts || ';etag=W/"' || mine || '"' END AS headers,
       CASE WHEN mine = digest THEN sha256(html) END AS payload_sha256
FROM m
"""

# -- 7 ---------------------------------------------------------------------------------------------------------------


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


OP7_SQL = """
WITH r AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM conversations
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role, md5(text)) AS n, count(*) OVER (PARTITION BY conv_id, own) AS size FROM r
), p AS (
  SELECT conv_id, n, size, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '')
                     OVER (PARTITION BY conv_id, own ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chat FROM t
), w AS (SELECT CASE WHEN count(*) = count(conv_id) THEN min(conv_id) END AS conv_id, n, chat, count(*) AS copies FROM p WHERE n = size GROUP BY n, chat)
SELECT conv_id, n AS n_turns, copies, chat FROM w
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n = w.n AND p.chat = w.chat AND p.n < p.size)
"""

# -- 8 ---------------------------------------------------------------------------------------------------------------


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n AS MATERIALIZED (SELECT *, row_number() OVER () AS own FROM v
), s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND c.own <> q.own
)
SELECT query_id, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) <= 5
"""

# -- 9 ---------------------------------------------------------------------------------------------------------------


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


# -- 10 --------------------------------------------------------------------------------------------------------------


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.with_spans(docs, words=secrets.dictionary(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secrets.digest(F.col("spans"), ("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"))


# -- 11 --------------------------------------------------------------------------------------------------------------


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS own, doc_id, {_TERMS} AS terms FROM documents),
s AS MATERIALIZED (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
a AS (SELECT row, item_id, unnest(list_distinct(terms)) AS term FROM (SELECT row_number() OVER () AS row, item_id, {_TERMS} AS terms FROM benchmark)),
t AS (SELECT own, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
f AS MATERIALIZED (SELECT own, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM a) GROUP BY own, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term),
i AS (SELECT own, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))) AS impact FROM f JOIN w USING (term), s),
r AS (SELECT row, any_value(item_id) AS item_id, own, any_value(doc_id) AS doc_id, sum(impact)::BIGINT AS score FROM a JOIN i USING (term) GROUP BY row, own)
SELECT item_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id NULLS LAST) <= 10
"""

# -- 12 --------------------------------------------------------------------------------------------------------------


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), m AS (
  SELECT doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM d
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), k AS (
  SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, a::INT + b::INT + c::INT + d::INT + e::INT AS many,
         count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL
), f(letter) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), o AS (
  SELECT v.letter || w.letter || x.letter || y.letter || z.letter AS filter_order FROM f v, f w, f x, f y, f z
  WHERE len(list_distinct([v.letter, w.letter, x.letter, y.letter, z.letter])) = 5
), s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS letter, substr(filter_order, 1, step::INT - 1) AS earlier FROM o, range(1, 6) r(step)
), g AS (
  SELECT part, filter_order, step, letter, n, good, toxic, many, fails[letter] AS fails, len(list_filter(string_split(earlier, ''), lambda x: x <> '' AND fails[x])) > 0 AS gone FROM k, s
)
SELECT part, filter_order, step, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END)::BIGINT AS removed,
       sum(CASE WHEN gone AND fails THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails AND many = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
       sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
       sum(sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END)) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM g GROUP BY part, filter_order, step, letter
"""

# -- 13 --------------------------------------------------------------------------------------------------------------


def op13_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sounds = media.encoded(docs).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "media")
    return media.described(sounds).select("doc_id", "n_bytes", "sound.*")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_url_filters,
        op3_simhash_near_dedup,
        op4_quality_classifier,
        op5_source_mixing,
        op6_warc_revisits,
        op7_chat_formatting,
        op8_topk_search,
        op9_benchmark_decontamination,
        op10_secret_scans,
        op11_ranked_lexical_search,
        op12_filter_interaction_audit,
        op13_media_columns,
    )
}
SQL = {
    "op2_url_filters": OP2_SQL,
    "op5_source_mixing": OP5_SQL,
    "op6_warc_revisits": OP6_SQL,
    "op7_chat_formatting": OP7_SQL,
    "op8_topk_search": OP8_SQL,
    "op11_ranked_lexical_search": OP11_SQL,
    "op12_filter_interaction_audit": OP12_SQL,
}
