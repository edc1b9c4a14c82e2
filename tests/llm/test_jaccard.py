"""Near copies of the pipeline: exact five-word Jaccard against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from auditlake.llm import jaccard

SHAPE = "doc_id long, text string, lang string"


def sets_by_hand(text, n=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def firsts_by_hand(rows):
    sets, label = [sets_by_hand(r[1]) for r in rows], list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if (a == b or 5 * len(a & b) >= 4 * len(a | b)) and label[i] != label[j]:
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    return sorted(min(rows[i][0] for i in range(len(rows)) if label[i] == x) for x in set(label))


@pytest.mark.parametrize("chunk", [1024, 2])
def test_keep_one(spark, chunk, monkeypatch):
    """Chains of near copies around 0.8, a passage that all share, and copies that differ by white space and case."""
    monkeypatch.setattr(jaccard.linked, "__defaults__", (chunk,))
    monkeypatch.setattr(jaccard, "SAMPLE", 2)
    rng = random.Random(4)
    words, passage = [f"word{i}" for i in range(300)], [f"p{i}" for i in range(12)]
    texts = []
    for _ in range(8):
        w = [rng.choice(words) for _ in range(rng.randrange(30, 90))] + passage
        for _ in range(14):
            w = list(w)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    texts += [" ".join(passage), "  ".join(passage).upper(), None, "", "one", "One ", "two three"]
    rng.shuffle(texts)
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    got = jaccard.keep_one(spark.createDataFrame(rows, SHAPE))
    assert got.columns == ["doc_id", "text", "lang"]
    want = firsts_by_hand(rows)
    assert sorted(r.doc_id for r in got.collect()) == want and 8 < len(want) < len(rows) - 20


def test_stage_finds_near_copies(spark):
    """Two changed words in 100 leave 0.8 of the five-word shingles, and more than three bits of a fingerprint apart."""
    import corpus_pipeline

    rng, rows = random.Random(1), []
    for i in range(20):
        w = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        rows.append((2 * i, " ".join(w), "en"))
        w[30] = w[70] = "changed"
        rows.append((2 * i + 1, " ".join(w), "en"))
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.createDataFrame(rows, SHAPE), "")
    assert sorted(r.doc_id for r in got.collect()) == list(range(0, 40, 2))


def test_empty(spark):
    assert jaccard.keep_one(spark.createDataFrame([], SHAPE)).collect() == []


def test_parities_lose_nothing():
    """Sets at exactly 0.8 pass whatever their numbers of places; unrelated ones don't."""
    for n in (1, 8, 64, 900, 5000):
        own = jaccard.shingles(" ".join(map(str, range(n + 4))).encode())
        fewer = own[: max(1, -(-4 * n // 5))]
        assert len(own) == n and jaccard.may_be_alike(jaccard.parities(own), jaccard.parities(fewer), len(own) + len(fewer))
    other = jaccard.shingles(" ".join(map(str, range(10_000, 15_004))).encode())
    assert not jaccard.may_be_alike(jaccard.parities(own), jaccard.parities(other), len(own) + len(other))


def test_repeated_and_missing_ids(spark):
    """One row for each component, also where a doc_id repeats with another text or is missing."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(3, a, "en"), (7, a, "en"), (7, b, "en"), (None, a, "en"), (None, c, "en"), (None, c, "en"), (None, c, "fr")]
    got = sorted((str(r.doc_id), r.text) for r in jaccard.keep_one(spark.createDataFrame(rows, SHAPE)).collect())
    assert got == [("3", a), ("7", b), ("None", c)]


def test_a_large_group_of_near_copies_forms_few_pairs(spark, monkeypatch):
    """Copies of one text with edits of their own: components are linked by a few members, not by all pairs."""
    met, whole = [], jaccard.verified

    def counted(pairs, docs, sets):
        met.append(pairs.count())
        return whole(pairs, docs, sets)

    monkeypatch.setattr(jaccard, "verified", counted)
    rng = random.Random(9)
    base, rows = [f"w{i}" for i in range(160)], []
    for i in range(240):
        w = list(base)
        for at in rng.sample(range(160), rng.choice((1, 2, 3, 4))):
            w[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en"))
    got = jaccard.keep_one(spark.createDataFrame(rows, SHAPE))
    assert sorted(r.doc_id for r in got.collect()) == firsts_by_hand(rows)
    assert sum(met) < 12 * len(rows)
