"""Every stage of the pipeline against brute force, on all documents of the smallest table and some odd ones."""

from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_jaccard import sets_by_hand
from test_operators import SF, budgets_by_hand, place
from test_pure import base_spans

from auditlake.llm import decontam, quality, queries, secrets

STAGES = dict(corpus_pipeline.STAGES)
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    """Null and empty texts, missing and repeated ids, equal rows, a near copy."""
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(None, None, None, None, None), (None, None, None, None, None), (10**6, "", "en", "src1", 0), (10**6, long, "en", "src1", 9), (10**6, long, "en", "src1", 9), (10**6 + 1, long + " more", "fr", "src2", 9)]
    return spark.createDataFrame(rows, SHAPE)


@pytest.fixture(scope="module")
def documents(spark):
    docs = queries.table(spark, SF, "documents")
    return docs.unionByName(odd(spark).select(*[F.col(c).cast(t).alias(c) for c, t in docs.dtypes])).cache()


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_quality_stage(spark, documents):
    """The scores with all pairs of features, one by one, decide who stays."""
    model = quality.train(documents, queries.table(spark, SF, "labels"))
    weight, factor, want = model.weight.astype(float), model.factor.astype(float), Counter()
    for row in documents.collect():
        found = quality.Rows.of([quality.features(row.text)])
        x, v = found.value.astype(float), factor[found.index]
        products = (v @ v.T) * np.outer(x, x)
        z = model.bias + weight[found.index] @ x + np.triu(products, 1).sum()
        score = 1 / (1 + np.exp(-z))
        assert abs(score - quality.THRESHOLD) > 1e-5
        if score >= quality.THRESHOLD:
            want[tuple(row)] += 1
    assert rows_of(STAGES["quality_classifier"](spark, documents, SF)) == want and 0 < sum(want.values()) < documents.count()


def test_near_duplicate_stage(spark, documents):
    """All pairs of shingle sets; of each component the row of the smallest id, rows without one last."""
    rows = documents.collect()
    sets = [sets_by_hand(r.text.translate({c: 32 for c in (9, 10, 11, 12, 13)}) if r.text else r.text) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and (sets[i] == sets[j] or sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    groups = defaultdict(list)
    for row, x in zip(rows, label):
        groups[x].append(row)
    got = STAGES["near_duplicates"](spark, documents, SF).collect()
    assert len(got) == len(groups)
    least = lambda g: min((r.doc_id is None, r.doc_id or 0) for r in g)
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got) == Counter(least(g) for g in groups.values())


def test_decontamination_stage(spark, documents):
    """Every item aligned with every whole document that has words enough of it."""
    items = [decontam.tokens(r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    index = decontam.Index([(i, w) for i, w in enumerate(items) if w])
    want = Counter()
    for row in documents.collect():
        flat, _, many = index.read([row.text])
        words = flat[: many[0]]
        copied = any(2 * min(int(np.isin(words, q).sum()), int(np.isin(q, words).sum())) >= len(q) and decontam.align(q, words)[0] >= len(q) for q in index.items)
        if not copied:
            want[tuple(row)] += 1
    assert rows_of(STAGES["decontamination"](spark, documents, SF)) == want and sum(want.values()) < documents.count()


def test_secret_stage(spark, documents):
    """All rows stay; every fixed span is gone, and texts without any span are as they were."""
    words = secrets.dictionary(documents)
    want = Counter()
    for r in documents.collect():
        text = r.text and secrets.redacted(r.text, secrets.scan(r.text, words=words))
        assert not text or not base_spans(text)
        assert not r.text or base_spans(r.text) or secrets.scan(r.text, words=words) or text == r.text
        want[(r.doc_id, text, r.lang, r.source, text if text is None else len(text))] += 1
    got = STAGES["secret_scans"](spark, documents, SF)
    assert rows_of(got.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"))) == want


def test_mixing_stage(spark, documents):
    """Budgets by water-filling and prefixes of whole orders."""
    domain = lambda s: "other" if s is None or not s.startswith("src") else "web" if int(s[3:]) < 10 else "books" if int(s[3:]) < 15 else "code" if int(s[3:]) < 20 else "other"
    leaves = defaultdict(list)
    for r in documents.collect():
        n = len((r.text or "").translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ")) - (r.text or "").translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ").count("")
        leaves[domain(r.source), r.lang or "(none)", r.source or "(none)"].append((r.doc_id, r.text, n))
    supply = {k: sum(n for _, _, n in v) for k, v in leaves.items()}
    (over, under), epochs = queries.MIX_SHARE, queries.MIX_EPOCHS
    want = Counter()
    for k, budget in budgets_by_hand(supply, queries.MIX_WEIGHTS, sum(supply.values()) * over // under, epochs).items():
        whole = min(budget // supply[k], epochs) if supply[k] else 0
        for e in range(1, whole + 1):
            want.update((d, t, e) for d, t, _ in leaves[k])
        so_far = 0
        for d, t, n in sorted(leaves[k], key=lambda x: place(queries.MIX_SEED, whole + 1, *x[:2])):
            so_far += n
            if so_far <= budget - whole * supply[k]:
                want[d, t, whole + 1] += 1
    got = STAGES["source_mixing"](spark, documents, SF)
    assert Counter((r.doc_id, r.text, r.epoch) for r in got.collect()) == want


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    none = queries.table(spark, SF, "documents").limit(0).withColumn("score", F.lit("own")).withColumn("Text2", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.collect() == [] and (name == "source_mixing" or out.columns == none.columns)


def test_run(spark):
    docs = queries.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
    assert rows_of(corpus_pipeline.run(spark, SF)) == rows_of(docs)
