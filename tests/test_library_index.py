"""The store's index against the plain search, and what it reads."""

import random

import pytest

from auditlake.operators import library, library_index

ROWS = "report_key string, event_id string, report_date string, cutoff string, title string, summary string, products array<string>"


def plan_files(df):
    """Files that the scans of an executed plan have read."""
    df.collect()
    leaves, total = df._jdf.queryExecution().executedPlan().collectLeaves(), 0
    for n in range(leaves.size()):
        metric = leaves.apply(n).metrics().get("numFiles")
        total += metric.get().value() if metric.isDefined() else 0
    return total


def test_search_over_parts(spark, tmp_path):
    rng = random.Random(3)
    words = ["import", "Duty", "duties", "éclair", "Zoll", "100%", "a_b", "widget-7", "import duty", "京东", "new"]
    make = lambda key, n: (key, f"e{n}", f"2026-01-0{rng.randrange(1, 9)}", key, " ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, k=5)), rng.choices(words, k=2))
    first, second = [make(f"r{n % 6}", n) for n in range(40)], [make(f"r{n % 3}", n + 20) for n in range(30)]
    store = f"file://{tmp_path}/store"
    assert library_index.live(spark, store) is None and library_index.search(spark, store, "x", library.SEARCHED).collect() == []
    for rows in (first, second):
        df = spark.createDataFrame(rows, ROWS)
        library_index.append(spark, store, df.select("report_key", "report_date").distinct(), df, library.SEARCHED)
    (tmp_path / "store" / "part=3" / "sightings").mkdir(parents=True)  # an ingest that broke off
    kept = [r for r in first if r[0] not in ("r0", "r1", "r2")] + second
    plain = spark.createDataFrame(kept, ROWS)
    queries = ["dut", "import", "port", "t dut", "%y", "a_b", "100%", "É", "éc", "京", "Zoll w", "widget-7", "7", "-", "new zzz", "zzz", "DUTY I"]
    for compacted in (False, True):
        if compacted:
            library_index.compact(spark, store, library.SEARCHED)
        assert sorted(map(str, library.tables(spark, store)[1].drop("part").select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
        for q in queries[:: 1 if compacted else 4]:
            assert library.find(spark, store, q, 7).collect() == library.search(plain, q, 7).collect(), q
    for bad in (" ", ""):
        with pytest.raises(ValueError):
            library.find(spark, store, bad)


def test_a_prefix_reads_few_files(spark, tmp_path):
    rows = spark.range(2000).selectExpr("'r' report_key", "cast(id as string) event_id", "'2026-01-01' report_date", "'c' cutoff", "concat(char(97 + id % 26), 'word', id) title", "'' summary", "array() products")
    store = f"file://{tmp_path}/store"
    library_index.append(spark, store, rows.select("report_key", "report_date").distinct(), rows, library.SEARCHED)
    postings = spark.read.parquet(f"{store}/part=1/postings")
    found = library_index.of_prefixes(postings, ["cword2"])
    assert 0 < plan_files(found) * 5 < plan_files(postings) and found.count() == len([n for n in range(2000) if n % 26 == 2 and str(n).startswith("2")])
