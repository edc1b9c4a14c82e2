"""What the plans of queries over whole texts leave out."""

from pyspark.sql import functions as F

from auditlake import workloads
from auditlake.functions import text

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def documents(spark, folder):
    rows = [(i, f"Sellers MUST file by 2026-01-{i % 3 + 10} a fee of {i % 2}0 % word{i % 4}", "en", "a", 10) for i in range(12)]
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_obligations_lower_a_text_once(spark, tmp_path):
    out = spark.range(1).select(text.obligations(F.concat(F.lit("It MUST, and may not"), F.col("id").cast("string"))).alias("x"))
    assert out.first().x == ["may not", "must"] and "Contains(lower" not in plan(out) and "contains(lower" not in plan(out).lower()
    assert spark.sql("select cast(null as string) t").select(text.obligations(F.col("t")).alias("x")).first().x == []


def test_facts_need_a_digit_first(spark):
    said = "2026年1月3日, 1234567 and 12.5 %, 3 days, 三十天, x20 days, 五"
    assert spark.createDataFrame([(said,)], "t string").select(text.facts(F.col("t")).alias("x")).first().x == sorted(["2026年1月3日", "1234567", "12.5%", "3days", "三十天", "20days"])


def test_changes_join_no_texts(spark, tmp_path):
    """Facts and obligations are read before the join of neighbours."""
    out = workloads.classify_change(spark, documents(spark, tmp_path))
    joined = plan(out)
    assert "may not" not in joined[: joined.index("Join")] and "may not" in joined
    assert out.count() == 11 and all("summary_facts_or_obligation" in r.reasons for r in out.collect())


def test_word_sets_are_met_once(spark, tmp_path):
    out = workloads.jaccard_products(spark, documents(spark, tmp_path))
    assert "array_union" not in plan(out)
    assert {(r.both, r.either) for r in out.collect()} <= {(b, e) for b in range(8, 14) for e in range(12, 18)}
