"""Not-modified revisits of a web archive, resolved to the responses they stand for.

A crawler that is answered "not modified" stores a revisit record with validators and a few headers, but no body. Each
revisit is joined, as of its time, to the latest earlier full response (status 200) of the same canonical URL. If the
validators agree (entity tags, weak or strong; without two of them, the last-modified times) the response's body holds
again, and the headers that a not-modified answer may renew replace the stored ones.

A URL crawled very often does not meet in one task. Captures of a second are summed up first: its last response is what
every revisit after it may stand for. Seconds are dealt to spans of time, and each span's last response is carried to
the later spans of its URL, so an ordered pass holds a span's seconds or a URL's spans, whatever the number of captures.
Revisits then look up their second; a URL with many of them is dealt to several tasks (``join_unique``), so that one
body's revisits don't gather either. Bodies are joined by record id once the match is known.

Input columns: record_id, url, ts (whole seconds), kind (``response`` or ``revisit``), status, etag, last_modified,
headers (map), payload. Outcomes: ``resolved``, ``mismatch`` (validators differ), ``no_validator`` (no pair of them to
compare), ``no_prior`` (no earlier response; also for null urls and times). A response without a payload has the empty
one. A response of the same second is not
earlier; of several in one second the largest record_id holds. Header names are lower-cased; null maps are empty.
Repeated revisit rows stay repeated; a response's record_id is expected to be unique, and of rows that repeat one the
largest payload holds. Further columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import cut, join_unique, stored

#: Seconds in a span of time.
SPAN = 86_400
# The headers that a 304 answer may renew.
RENEWED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that don't name a page.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without a last slash, other parameters sorted."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/$", "")
    asked = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    out = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(F.trim(url) != "", out)


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that then agree, the last in order holds."""
    pairs = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    once = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(once), F.create_map().cast("map<string,string>"))


def resolve(records: DataFrame, span: int = SPAN) -> DataFrame:
    """Every revisit: record_id, url, canonical_url, ts, outcome, refers_to, and if resolved headers and payload."""
    url, at = canonical_url(F.col("url")).alias("canonical_url"), F.floor(F.col("ts") / span).alias("span")
    validators = ("etag", "last_modified")
    asked = records.filter("kind = 'revisit'").select("record_id", "url", url, "ts", at, *validators, _lower_keys(F.col("headers")).alias("headers"))
    full = records.filter("kind = 'response' and status = 200 and record_id is not null").select("record_id", "payload", "headers", url, "ts", at, *validators)
    full = full.filter("canonical_url is not null and ts is not null")
    dated = asked.filter("canonical_url is not null and ts is not null")

    second = ("canonical_url", "span", "ts")
    known = full.select(*second, F.struct("ts", "record_id", *validators).alias("prior"))
    seconds = known.unionByName(dated.select(*second), allowMissingColumns=True).groupBy(*second).agg(F.max("prior").alias("prior"))
    spans = seconds.groupBy("canonical_url", "span").agg(F.max("prior").alias("prior"))
    earlier = lambda key, order: Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("canonical_url", "span", F.max("prior").over(earlier(["canonical_url"], "span")).alias("before"))
    seconds = seconds.withColumn("prior", F.max("prior").over(earlier(["canonical_url", "span"], "ts"))).join(spans, ["canonical_url", "span"])
    seconds = seconds.select("canonical_url", "ts", F.coalesce("prior", "before").alias("prior"))

    of_url = cut(dated.groupBy("canonical_url").agg(F.count("*").alias("n")))
    met = join_unique(dated.drop("span"), seconds, ["canonical_url", "ts"], "canonical_url", of_url)
    met = met.unionByName(asked.filter("canonical_url is null or ts is null").drop("span"), allowMissingColumns=True)

    weak = lambda tag: F.regexp_replace(F.trim(tag), "^W/", "")
    agree = F.coalesce(weak(F.col("etag")) == weak(F.col("prior.etag")), F.trim("last_modified") == F.trim("prior.last_modified"))
    outcome = F.when(F.col("prior").isNull(), "no_prior").when(agree.isNull(), "no_validator").when(agree, "resolved").otherwise("mismatch")
    met = met.withColumn("outcome", outcome).withColumn("refers_to", F.when(F.col("outcome") == "resolved", F.col("prior.record_id")))
    met = stored(met.drop("prior", *validators), "revisits")

    named = full.select(F.col("record_id").alias("refers_to"), "canonical_url", "payload", _lower_keys(F.col("headers")).alias("stored"))
    needed = met.filter("refers_to is not null").select("refers_to").distinct()
    bodies = named.join(needed, "refers_to", "left_semi").groupBy("refers_to", "canonical_url")
    bodies = bodies.agg(F.max(F.struct(F.coalesce("payload", F.lit("")).alias("p"), F.to_json("stored").alias("s"))).alias("b"))
    found = join_unique(met.filter("refers_to is not null"), bodies, ["refers_to"], "canonical_url", of_url)
    found = found.unionByName(met.filter("refers_to is null"), allowMissingColumns=True).withColumn("stored", F.from_json("b.s", "map<string,string>"))
    renewed = F.map_filter("headers", lambda k, _: k.isin(*RENEWED))
    merged = F.map_concat(F.map_filter("stored", lambda k, _: ~F.map_contains_key(renewed, k)), renewed)
    return found.select(
        "record_id", "url", "canonical_url", "ts", "outcome", "refers_to",
        F.when(F.col("outcome") == "resolved", merged).alias("headers"),
        F.when(F.col("outcome") == "resolved", F.col("b.p")).alias("payload"),
    )
