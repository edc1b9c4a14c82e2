"""Reports, registries, catalogs and receipts as JSON files, and the tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import validation

#: Files over this size are no run artefacts.
ARTEFACT_LIMIT = 10 * 1024 * 1024


def raw(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """report (its path) and raw (its text) of every JSON file."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.json").text(path)
    return files.select(F.col("_metadata.file_path").alias("report"), F.col("value").alias("raw"), F.col("_metadata.file_size").alias("size"))


def split_valid(reports: DataFrame, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(reports without violations, skipped reports with how many they have)."""
    bad = validation.violations(reports, aliases).groupBy("report").agg(F.count("*").alias("violations"))
    return reports.join(bad, "report", "left_anti"), bad


def load_one(spark: SparkSession, path: str) -> DataFrame:
    """A single valid report, or an error with the first violations."""
    reports = raw(spark, path)
    found = validation.violations(reports)
    if not found.isEmpty():
        raise ValueError("report failed validation: " + validation.preview(found))
    return reports


EVENT = (
    "id string, title string, status string, level string, score int, jurisdiction string, authority string, published_date string, effective_date string, deadline string,"
    "products_or_channels array<string>, summary string, impact string, action string, rationale string, source_title string, source_url string, retrieved_date string,"
    "published_at string, effective_at string, deadline_at string, source_timezone string, hs_codes array<string>,"
    "score_breakdown struct<regulatory_force:int,business_exposure:int,urgency:int,consequence:int,evidence:int>,"
    "platform_policy struct<platform:string,seller_market:string,program:string,policy_area:string,change_type:string,seller_scope:string,previous_state:string,new_state:string,enforcement_consequence:string,backend_verification_required:boolean>"
)


def events(reports: DataFrame) -> DataFrame:
    """One row an event: report, report_date, cutoff, scope, pos and the event's fields."""
    shape = f"report_date string, cutoff string, language string, scope array<string>, events array<struct<{', '.join(_colons(EVENT))}>>"
    rows = reports.select("report", F.from_json("raw", shape).alias("r")).select("report", "r.report_date", "r.cutoff", "r.language", "r.scope", F.posexplode("r.events").alias("pos", "e"))
    out = rows.select("report", "report_date", "cutoff", "language", "scope", "pos", "e.*")
    return out.withColumnsRenamed({"products_or_channels": "products", "platform_policy": "policy"})


def _colons(ddl: str) -> list[str]:
    """Fields of a DDL as fields of a struct type."""
    depth, part, out = 0, "", []
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, _, kind = part.strip().partition(" ")
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += c
    return out


def run_artefacts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(manifests, receipts) of a run's folder, told apart by their keys; other and oversized files are left."""
    rows = raw(spark, path).filter(F.col("size") <= ARTEFACT_LIMIT).withColumn("keys", F.json_object_keys("raw"))
    has = lambda *names: F.forall(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains("keys", n))
    return rows.filter(has("manifest_id", "tasks")), rows.filter(has("task_id", "result", "checked_at") & ~has("tasks"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog items, one row a sku; other schema versions are refused."""
    item = "sku:string,name:string,hs_codes:array<string>,keywords:array<string>,markets:array<string>,platforms:array<string>"
    rows = raw(spark, path).select(F.from_json("raw", f"schema_version string, organization string, items array<struct<{item}>>").alias("c"))
    checked = F.when(F.col("c.schema_version") == "1.0", F.col("c.items")).otherwise(F.raise_error(F.lit("catalog schema_version must be 1.0")))
    out = rows.select("c.organization", F.explode(checked).alias("i")).select("organization", "i.*")
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("hs_codes", "keywords", "markets", "platforms")}).withColumn("hs_codes", F.transform("hs_codes", lambda x: F.regexp_replace(x, r"[.\s-]", "")))


def registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(routes, aliases) of a folder of platform files."""
    route = "route_id:string,source_type:string,url:string,markets:array<string>,access:string,evidence_role:string,verification_status:string,last_verified_on:string,verify_before_use:boolean"
    rows = raw(spark, path).select(F.from_json("raw", f"id string, display_name string, aliases array<string>, official_routes array<struct<{route}>>").alias("p"))
    routes = rows.select(F.col("p.display_name").alias("platform"), F.explode("p.official_routes").alias("r")).select("platform", "r.*")
    names = F.array_distinct(F.concat(F.array("p.id", "p.display_name"), F.coalesce("p.aliases", F.array().cast("array<string>"))))
    return routes.withColumn("markets", F.coalesce("markets", F.array(F.lit("*")))), rows.select(F.explode(names).alias("alias"), F.col("p.display_name").alias("platform"))


def official_sources(spark: SparkSession, path: str) -> DataFrame:
    """Routes of official sources, one row a route, from files with an array of sources."""
    route = "label:string,url:string,source_type:string,topics:array<string>"
    source = f"id:string,display_name:string,jurisdiction:string,authority:string,aliases:array<string>,routes:array<struct<{route}>>"
    rows = raw(spark, path).select(F.explode(F.from_json("raw", f"sources array<struct<{source}>>")["sources"]).alias("s"))
    return rows.select("s.*").withColumn("r", F.explode("routes")).drop("routes").select("*", "r.*").drop("r")
