"""Ranked search, the filter audit and media columns against brute force: nulls, ties, repeated rows, empty tables."""

import cmath
import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import filter_audit, lexical, media, queries

SF = "/root/testdata/sf0.001"

# -- ranked search -----------------------------------------------------------------------------------------------------


def terms_by_hand(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small)


def ranked_by_hand(docs, items, k):
    read = [(d, terms_by_hand(t)) for d, t in docs]
    read = [x for x in read if x[1]]
    many, total = len(read), sum(len(t) for _, t in read)
    having = Counter(w for _, t in read for w in set(t))
    out = []
    for item, text in items:
        scored = []
        for d, t in read:
            m, score = 100 - 90 + (90 * len(t) * many) // total, 0
            for w in set(terms_by_hand(text)):
                tf = t.count(w)
                if tf:
                    score += math.floor(1000 * math.log((2 * many + 2) / (2 * having[w] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((score, d))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, rank, d, score) for rank, (score, d) in enumerate(scored[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("block, postings", [(500_000, 2_000_000), (7, 40)])
def test_ranked(spark, monkeypatch, block, postings):
    """With small blocks several indexes of items, and many blocks of documents, share one heap."""
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", postings)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    pick = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=n))
    docs = [(i, pick(rng.randrange(1, 60))) for i in range(120)]
    docs += [(None, docs[3][1]), (500, docs[3][1]), (500, docs[3][1]), (501, None), (502, ""), (503, " .,-"), (-4, docs[3][1].upper()), (504, "É é ÉÉ w1 " * 30)]
    items = [(i, pick(rng.randrange(1, 12))) for i in range(12)] + [(3, "W1-w2;w3"), (3, "w1-w2;w3"), (None, "w5 é"), (20, None), (21, "?"), (22, "unknown")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("own")).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(1))
    got = [tuple(r) for r in lexical.ranked(table, asked, 4, block).collect()]
    assert sorted(map(str, got)) == ranked_by_hand(docs, items, 4)


def test_ranked_empty(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.withColumn("text", F.lit(None).cast("string")), items)):
        found = lexical.ranked(d, i)
        assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_pivots_skip_documents():
    """Documents that only hold a common word are not scored once the heap is full."""
    many = 5000
    sizes = np.array([2 if d % 500 == 0 else 1 for d in range(many)])
    words = np.array([w for d in range(many) for w in ([0, 1] if d % 500 == 0 else [0])], np.int32)
    block = lexical.Block(list(range(many)), np.full(many, 100), sizes, words, np.ones(len(words), np.int32), np.array([10, 4000]))
    heap = []
    scored = block.search([0, 1], heap, 3)
    assert sorted(-d for _, d in heap) == [0, 500, 1000] and scored == 1001 + 7  # until two more have the rare word, then these alone


# -- audit -------------------------------------------------------------------------------------------------------------


def audit_by_hand(docs, labels):
    def fails(d, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        same = [e for e, t, _ in docs if (t or "") == text and e is not None]
        return {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": d is not None and min(same) < d,
        }

    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    rows = [(d, lang or "", fails(d, t or "")) for d, t, lang in docs]
    out, shares = {}, Counter()
    for part, order in itertools.product({p for _, p, _ in rows}, itertools.permutations("ABCDE")):
        left = [r for r in rows if r[1] == part]
        for step, f in enumerate(order, 1):
            gone = [r for r in left if r[2][f]]
            before = [r for r in rows if r[1] == part and r not in left]
            alone = sum(r[1] == part and r[2][f] and sum(r[2].values()) == 1 for r in rows)
            left = [r for r in left if not r[2][f]]
            shares[part, f] += len(gone)
            out[part, "".join(order), step] = [len(left), len(gone), sum(r[2][f] for r in before), alone, sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.lit(7).cast("long"), lambda c: F.char_length(c).cast("long")])
def test_audit(spark, hashed):
    """Also where all hashes are equal, so that only the full texts tell documents apart."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"{c}ord" for c in "wbcdefghij"] + [f"x{i}" for i in range(150)], k=rng.choice([3, 90, 130]))) for _ in range(14)]
    texts += ["", " \t\n", "ABC def", "# " + texts[0], texts[1].upper(), "é" * 5000, "é" * 4999 + "e", "e" + "é" * 4999]
    docs = [(i * 3 % 61, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for i in range(60)]
    docs += [(None, texts[2], "en"), (None, None, None), (7, None, "de"), (8, "", "de"), (9, texts[2], "fr"), (9, texts[2], "fr"), (9, texts[3], "fr")]
    labels = [(d, rng.randrange(2), rng.randrange(2)) for d in range(0, 60, 2)] + [(2, None, None), (4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("part", F.lit("own")).withColumn("mask", F.lit(3))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(table, known, hashed).collect()}
    # rows that are alike in all columns still count each
    numbered = audit_by_hand(docs, labels)
    assert len(got) == 600 * 4 and [(k, v, numbered[k]) for k, v in sorted(got.items()) if v != numbered[k]] == []


def test_audit_empty(spark):
    docs = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), labels).collect() == []
    rows = filter_audit.audit(docs, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and sum(r.removed for r in rows) == 120 and {r.good_lost for r in rows} == {0}


def test_classes_shrink(spark):
    """Singletons go with the first split that parts them from the others."""
    texts = ["a" * 10, "a" * 10, "b" * 10, "c" * 11, "a" * 63 + "xy", "a" * 63 + "xz", "a" * 4200 + "p", "a" * 4200 + "q", "a" * 4200 + "q"]
    docs = spark.createDataFrame([(n, t, "") for n, t in enumerate(texts)], "doc_id long, text string, lang string")
    rows = filter_audit.measured(docs)
    assert {r.length for r in filter_audit.refined(rows).collect()} == {10, 4201} and filter_audit.refined(rows).count() == 2


# -- media -------------------------------------------------------------------------------------------------------------


def wav_by_hand(samples):
    pad = b"\x00" * (len(samples) % 2)
    head = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(samples))
    return b"RIFF" + struct.pack("<I", len(head) + len(samples)) + head + samples + pad


def peaks_by_hand(samples):
    """A plain discrete Fourier transform of each window, and the peaks of its bands."""
    count = 1 if len(samples) <= 256 else 1 + -(-(len(samples) - 256) // 128)
    wave = [cmath.exp(-2j * cmath.pi * k / 256) for k in range(256)]
    best = []
    for t in range(count):
        x = list(samples[t * 128 : t * 128 + 256])
        x += [128] * (256 - len(x))
        mean = sum(x) / 256
        x = [(v - mean) * (0.5 - 0.5 * math.cos(2 * math.pi * n / 255)) for n, v in enumerate(x)]
        size = [round(abs(sum(v * wave[n * f % 256] for n, v in enumerate(x))) * 16) for f in range(1, 129)]
        best.append([max((size[b * 32 + i], -(b * 32 + i + 1)) for i in range(32)) for b in range(4)])
    none = [(0, 0)] * 4
    around = [none, *best, none]
    return [(t, -best[t][b][1]) for t in range(count) for b in range(4) if around[t][b][0] < best[t][b][0] >= around[t + 2][b][0]]


def pairs_by_hand(found):
    out = []
    for t, f in found:
        later = [x for x in found if x[0] > t][:3]
        out += [(t, (f * 129 + g) * 64 + u - t) for u, g in later if u - t <= 63]
    return out


@pytest.mark.parametrize("size, chunk", [(0, 4096), (64, 4096), (255, 4096), (256, 4096), (321, 4096), (1500, 4096), (5000, 3), (5000, 4096)])
def test_fingerprint(monkeypatch, size, chunk):
    monkeypatch.setattr(media, "CHUNK", chunk)
    rng = random.Random(size)
    samples = media.payload(bytes(rng.choices(b"etaoin shrdlu,.\n", k=size)))
    found = peaks_by_hand(samples)
    at, frequency = media.peaks(media.samples_of(media.as_wav(samples), chunk * media.HOP))
    assert list(zip(at.tolist(), frequency.tolist())) == found
    times, codes = media.pairs(at, frequency)
    assert list(zip(times.tolist(), codes.tolist())) == pairs_by_hand(found)


def test_media_columns(spark):
    texts = ["", None, "a", "é" * 40, "x" * 64, "x" * 65, "word after word, " * 70000, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("media", F.lit("own")).withColumn("sound", F.lit(1))
    rows = media.described(media.encoded(docs)).select("doc_id", "media", "sound.*").collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        whole = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        assert bytes(r.media) == wav_by_hand(whole) and (r.payload_bytes, r.media_bytes) == (len(whole), len(whole) + 44)
        assert r.payload_sha256 == hashlib.sha256(whole).hexdigest() and r.media_sha256 == hashlib.sha256(wav_by_hand(whole)).hexdigest()
        assert r.tail_crc32 == zlib.crc32(whole[-64:]) and r.feature.startswith(f"{len(r.codes)}:") and len(r.times) == len(r.codes)
    by = {r.doc_id: r for r in rows}
    assert by[2].feature == by[7].feature and by[0][1:] == by[1][1:] and len(by[6].codes) > 1000
    assert media.described(media.encoded(docs.limit(0))).collect() == []
    with pytest.raises(ValueError):
        media.describe(b"".join((wav_by_hand(b"ab")[:22], b"\x02", wav_by_hand(b"ab")[23:])))


def test_media_query(spark):
    got = queries.op13_media_columns(spark, SF)
    assert got.columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    texts = {r.doc_id: (r.text or "").encode() for r in queries.table(spark, SF, "documents").collect()}
    assert all((r.n_bytes, r.payload_sha256) == (len(texts[r.doc_id]), hashlib.sha256(media.payload(texts[r.doc_id])).hexdigest()) for r in got.collect())
