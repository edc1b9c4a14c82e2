"""The operators over small tables: nulls, ties, repeated rows, empty tables, extra columns; brute force on the results."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import chat, decontam, html_extract, mixing, quality, queries, secrets, simhash, topk, url_filter, warc

SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_extract(spark):
    rows = [(1, None, None), (None, "u", "<article><p>Hi &eacute;</p></article>"), (1, "u", "")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")))
    assert sorted(map(str, got.select("page_id", "url", "text", "n_chars").collect())) == sorted(
        ["Row(page_id=1, url=None, text='', n_chars=0)", "Row(page_id=None, url='u', text='Hi é', n_chars=4)", "Row(page_id=1, url='u', text='', n_chars=0)"]
    )
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_url_filter_carries_other_columns(spark):
    pages = spark.createDataFrame([("http://q.org/", 1, "own")], "url string, fit long, Host string")
    assert url_filter.judge(pages, queries.URL_RULES).collect() == [("http://q.org/", 1, "q.org", "/", "org/", "allow")]
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).collect() == []


def test_url_filter(spark):
    rows = [(1, "HTTP://X.Example.ORG/en/12?a#b"), (2, None), (3, "no scheme"), (4, "https://a.com/de/1"), (4, "https://a.com/de/1"), (5, "x://b.net"), (6, "http://org/"), (7, "http://q.com/fr/#")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("old"))
    for most in (100, 2):  # one trie, several tries
        got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, queries.URL_RULES, max_rules=most).collect()}
        assert got == {
            (1, "x.example.org", "/en/12", "example.org/en/1", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.com", "/de/1", "com/de/", "block"),
            (5, "b.net", "", None, "allow"), (6, "org", "/", "org/", "allow"), (7, "q.com", "/fr/", "com/fr/", "allow"),
        }


def components_by_hand(rows, most=3):
    prints = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= most and label[i] != label[j]:
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    ids = {own: min((d for (d, _), m in zip(rows, label) if m == own and d is not None), default=None) for own in set(label)}
    return sorted((str(d), f"{p:016x}", str(ids[m])) for (d, _), p, m in zip(rows, prints, label))


@pytest.mark.parametrize("group", [4096, 6])
def test_near_duplicates(spark, group):
    """With a small group size the index divides hot groups down to pairs of chunks."""
    rng = random.Random(9)
    words = [f"word{i}" for i in range(200)]
    base = [[rng.choice(words) for _ in range(80)] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(80)] = rng.choice(words)
        rows.append((i * 7 % 150, " ".join(w)))
    rows += [(500, None), (501, ""), (None, " "), (502, "one"), (502, "one"), (503, "One  two"), (499, base[0] and " ".join(base[0]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("x"))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs, group=group).collect())
    assert got == components_by_hand(rows)


def test_dense_fingerprints(spark):
    """A subcube of nearly equal fingerprints: all of one component, through divided groups and chunks."""
    values = [(0x0123456789ABCDEF ^ sum(1 << (b * 5) for b in range(9) if k >> b & 1),) for k in range(512)]
    prints = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for (v,) in values], "fp long")
    found = simhash.components(simhash.near_edges(prints, group=16)).collect()
    assert len(found) == 511 and len({r.root for r in found}) == 1


def test_near_duplicates_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_quality(spark):
    docs, labels = queries.table(spark, SF.replace("0.001", "0.01"), "documents"), queries.table(spark, SF.replace("0.001", "0.01"), "labels")
    odd = docs_of(spark, [(None, None, None, None, None), (10_000_001, "", None, None, None)])
    got = quality.classify(docs.unionByName(odd), labels).collect()
    assert len(got) == docs.count() + 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.95 and np.mean([s >= 0.3 for s in good]) > 0.97
    assert quality.classify(docs.limit(0), labels).collect() == [] and quality.keep_good(docs.limit(0), labels).columns == docs.columns
    clash = odd.withColumn("score", F.lit("own")).withColumn("row", F.lit(1))
    assert quality.keep_good(clash, labels.limit(0)).select("score", "row").distinct().collect() == [("own", 1)]
    assert quality.classify(odd, labels.limit(0)).agg(F.min("score"), F.max("score")).first()[:] == (0.5, 0.5)


def budgets_by_hand(supply, weights, total, epochs):
    """Water-filling down the tree, one child after another."""
    out = {}

    def down(keys, budget, depth):
        if depth == 3:
            out[keys[0]] = budget
            return
        level = ("domain", "lang", "source")[depth]
        families = defaultdict(list)
        for k in keys:
            families[k[depth]].append(k)
        able = lambda k: all(weights.get(x, {}).get(v, 1) for x, v in zip(("domain", "lang", "source"), k))
        cap = {v: sum(supply[k] for k in ks if able(k)) * epochs for v, ks in families.items()}
        w = {v: weights.get(level, {}).get(v, 1) for v in families}
        live, left, given = {v for v in families if w[v]}, budget, dict.fromkeys(families, 0)
        while live:
            full = {v for v in live if cap[v] * sum(w[x] for x in live) <= w[v] * left}
            if not full:
                for v in live:
                    given[v] = min(cap[v], w[v] * left // sum(w[x] for x in live))
                break
            v = min(full, key=lambda x: cap[x] / w[x])
            given[v], left = cap[v], left - cap[v]
            live.remove(v)
        for v, ks in families.items():
            down(ks, given[v], depth + 1)

    able = [k for k in supply if all(weights.get(x, {}).get(v, 1) for x, v in zip(("domain", "lang", "source"), k))]
    down(list(supply), min(total, epochs * sum(supply[k] for k in able)), 0)
    return out


def place(seed, epoch, doc_id, text):
    own = hashlib.md5((text or "").encode()).hexdigest()
    return hashlib.md5(f"{seed}:{epoch}:{'' if doc_id is None else doc_id}:{own}".encode()).hexdigest()


@pytest.mark.parametrize("most", [100_000, 0])
def test_mixing(spark, most, monkeypatch):
    """With budgets on the driver, and by windows."""
    monkeypatch.setattr(mixing, "MAX_LEAVES", most)
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randrange(1, 30)), rng.choice(["en", "fr", None]), rng.choice(["src0"] * 5 + ["src1", "src12", "src15", "zz", None]), 1) for i in range(300)]
    rows += [(7, None, "en", "src0", 0), (7, "a b", "en", "src0", 0), *[(None, f"a b {i}", "en", "src0", 0) for i in range(20)]]
    docs = docs_of(spark, rows).withColumn("epoch", F.lit("x")).withColumn("__h", F.lit("own"))
    weights = {"domain": {"web": 10, "books": 60, "code": 0}, "lang": {"en": 3}, "source": {"src1": 9}}
    found = mixing.mix(docs, weights, queries.domain_of(), (4, 5), 2, "s").collect()
    assert {r["__h"] for r in found} == {"own"}
    got = Counter((r.doc_id, r.text, r.epoch) for r in found)
    domain = lambda s: "web" if s in ("src0", "src1") else "books" if s == "src12" else "code" if s == "src15" else "other"
    leaves = defaultdict(list)
    for d, t, lang, source, _ in rows:
        leaves[domain(source), lang or "(none)", source or "(none)"].append((d, t, len((t or "").split())))
    supply = {k: sum(n for _, _, n in v) for k, v in leaves.items()}
    want = Counter()
    for k, budget in budgets_by_hand(supply, weights, sum(supply.values()) * 4 // 5, 2).items():
        whole = min(budget // supply[k], 2) if supply[k] else 0
        for e in range(1, whole + 1):
            want.update((d, t, e) for d, t, _ in leaves[k])
        so_far = 0
        for d, t, n in sorted(leaves[k], key=lambda x: place("s", whole + 1, *x[:2])):
            so_far += n
            if so_far <= budget - whole * supply[k]:
                want[d, t, whole + 1] += 1
    assert got == want
    assert mixing.mix(docs.limit(0), weights, queries.domain_of()).collect() == []


def test_mixing_slices_match_whole_orders(spark):
    """A leaf of many documents, whose prefix ends within a slice."""
    docs = docs_of(spark, [(i, "w " * (i % 7), "en", "src0", 1) for i in range(3000)])
    got = sorted(r.doc_id for r in mixing.mix(docs, {}, queries.domain_of(), (1, 3), 1, "t").collect())
    total, so_far, want = sum(i % 7 for i in range(3000)) // 3, 0, []
    for i in sorted(range(3000), key=lambda i: place("t", 1, i, "w " * (i % 7))):
        so_far += i % 7
        if so_far <= total:
            want.append(i)
    assert got == sorted(want)


def test_warc(spark):
    kind = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, headers map<string,string>, payload string"
    day = 86_400
    rows = [
        (1, "http://www.a.org/x/?b=2&a=1&utm_source=z#top", 100, "response", 200, '"v1"', None, {"ETag": '"v1"', "Content-Type": "t", "Date": "1"}, "body1"),
        (2, "https://a.org/x?a=1&b=2", 5 * day, "response", 200, None, "Mon", {"Content-Type": "t"}, "body2"),
        (3, "https://a.org/x?a=1&b=2", 6 * day, "response", 404, '"v1"', None, None, "gone"),
        (10, "https://a.org/x?b=2&a=1", 100, "revisit", 304, '"v1"', None, {}, None),  # same second: not earlier
        (11, "https://A.org:443/x/?b=2&a=1", 101, "revisit", 304, 'W/"v1"', None, {"date": "2", "Content-Length": "0", "Vary": "x"}, None),
        (12, "https://a.org/x?b=2&a=1", 3 * day, "revisit", 304, '"v2"', None, None, None),
        (13, "https://a.org/x?b=2&a=1", 9 * day, "revisit", 304, None, "Mon", None, None),
        (14, "https://a.org/x?b=2&a=1", 9 * day, "revisit", 304, '"v1"', None, None, None),
        (15, None, 9 * day, "revisit", 304, '"v1"', None, None, None),
        (16, "https://a.org/y", None, "revisit", 304, '"v1"', None, None, None),
        (11, "https://A.org:443/x/?b=2&a=1", 101, "revisit", 304, 'W/"v1"', None, {"date": "2", "Content-Length": "0", "Vary": "x"}, None),
    ]
    got = warc.resolve(spark.createDataFrame(rows, kind).withColumn("prior", F.lit(1))).collect()
    by = {r.record_id: r for r in got}
    assert len(got) == 8 and {k: (r.outcome, r.refers_to) for k, r in by.items()} == {10: ("no_prior", None), 11: ("resolved", 1), 12: ("mismatch", None), 13: ("resolved", 2), 14: ("no_validator", None), 15: ("no_prior", None), 16: ("no_prior", None)}
    assert by[11].headers == {"etag": '"v1"', "content-type": "t", "date": "2", "vary": "x"} and by[11].payload == "body1" and by[12].payload is None
    assert warc.resolve(spark.createDataFrame([], kind)).collect() == []


@pytest.mark.parametrize("span", [86_400, 7])
def test_warc_hot_url(spark, span, monkeypatch):
    """One URL with most revisits, many of them in one second, against a plain search; a response without payload."""
    monkeypatch.setattr(warc.join_unique, "__defaults__", (3,))
    rng = random.Random(5)
    kind = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, headers map<string,string>, payload string"
    urls = ["http://hot.org/"] * 9 + ["http://b.org/x", "http://c.org/"]
    rows = [(i, rng.choice(urls), rng.randrange(40), "response", 200, rng.choice(['"a"', '"b"']), None, {"x": str(i)}, None if i % 3 else f"body{i}") for i in range(60)]
    rows += [(1000 + i, rng.choice(urls), rng.choice([20, rng.randrange(45)]), "revisit", 304, '"a"', None, None, None) for i in range(3000)]
    got = {r.record_id: (r.outcome, r.refers_to, r.payload) for r in warc.resolve(spark.createDataFrame(rows, kind), span).collect()}
    assert len(got) == 3000
    for own, url, at, *_ in rows[60:]:
        prior = max(((r[2], r[0]) for r in rows[:60] if r[1] == url and r[2] < at), default=None)
        record = prior and rows[prior[1]]
        same = record and record[5] == '"a"'
        assert got[own] == (("no_prior", None, None) if not prior else ("resolved", prior[1], record[8] or "") if same else ("mismatch", None, None))


def test_chat(spark):
    talks = {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"], 4: ["a"], 5: ["b", "a"], 6: ["a", "x"], None: ["z", "q", "q", "k"], 7: ["z", "y"], 9: ["k"]}
    rows = [(c, n, "user", t) for c, ts in talks.items() for n, t in enumerate(ts)] + [(8, 0, None, None), (8, 0, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(0)).withColumn("a", F.lit(0))
    got = {(r.conv_id, r.n_turns, r.copies) for r in chat.format_chats(table).collect()}
    assert got == {(2, 3, 2), (5, 2, 1), (6, 2, 1), (7, 2, 1), (8, 2, 1), (None, 1, 2)}
    shown = {r.conv_id: r.chat for r in chat.format_chats(table).collect()}
    alone = [r.chat for r in chat.format_chats(table).filter("conv_id is null").collect()]
    assert sorted(alone) == ["<|im_start|>user\nk<|im_end|>\n", "<|im_start|>user\nq<|im_end|>\n"]
    assert shown[5] == "<|im_start|>user\nb<|im_end|>\n<|im_start|>user\na<|im_end|>\n"
    assert chat.format_chats(table.limit(0)).collect() == []


@pytest.mark.parametrize("block", [1 << 20, 600])
def test_top_k(spark, block):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4) * rng.choice([0.2, 1])]) for i in range(130)]
    rows += [(200, None), (201, [1.0, None, 1.0, 1.0]), (202, [float("nan")] * 4), (203, [1.0]), (100, rows[100][1]), (None, [9.0] * 4), (150, []), (250, [2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    shares = []
    got = sorted(tuple(r) for r in topk.top_k(table, F.col("vec_id") % 50 == 0, block_bytes=block, query_bytes=block, shares=shares).collect())
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for own, (q, v) in enumerate(good):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for n, (i, w) in enumerate(good) if n != own and len(w) == len(v))[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert got == sorted(want) and 0 < shares[0] <= shares[1]
    assert topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_decontamination(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(6)] + [(50, "too short"), (51, None), (52, ""), (53, "Gone!")]
    filler = lambda n: " ".join(word() for _ in range(n))
    edited = items[1][1].split()
    for at in range(3, 30, 7):
        edited[at] = "changed"
    docs = [
        (0, f"{filler(200)} {items[0][1].upper()}!! {filler(50)}"), (1, f"{filler(90)}\n{' '.join(edited)} {filler(9)}"), (2, filler(300)), (3, None), (4, ""), (5, items[2][1]), (None, items[2][1]),
        (6, " ".join(items[3][1].split()[:10])), (7, f"{items[4][1]} {filler(5000)} {items[5][1]}"), (8, "the the the the"), (10, "-- too SHORT"), (11, "it is too short, too short!"), (12, "gone"), (13, "too, but not short"), (9, " ".join(w for n, x in enumerate(items[4][1].split()) for w in ([x, "um"] if n % 5 == 4 else [x]))),
    ]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(0)).withColumn("matches", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (500_000, 40):  # one index, one an item
        found = decontam.with_matches(table.select("doc_id", "text"), bench, block=block).select("doc_id", F.explode("matches").alias("m")).collect()
        assert {(r.doc_id, r.m.item_id) for r in found} == {(0, 0), (1, 1), (5, 2), (None, 2), (7, 4), (7, 5), (9, 4), (10, 50), (11, 50), (12, 53)}
    assert [(r.first_word, r.last_word, r.score) for r in decontam.contaminated(table, bench).filter("doc_id = 0").collect()] == [(200, 229, 1.0)]
    assert sorted((r.first_word, r.last_word) for r in decontam.contaminated(table, bench).filter("doc_id = 11").collect()) == [(2, 3), (4, 5)]
    kept = decontam.clean(table, bench)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6, 8, 13]
    assert decontam.clean(table, bench.limit(0)).count() == len(docs) and decontam.contaminated(table.limit(0), bench).collect() == []


def test_secrets(spark):
    docs = docs_of(spark, [(1, "é password=abcdef", "en", "s", 17), (2, None, None, None, None), (2, "", "en", "s", 0)]).withColumn("spans", F.lit(0))
    got = secrets.with_spans(docs).select("doc_id", secrets.digest(F.col("spans")).alias("d")).collect()
    assert sorted((r.doc_id, r.d) for r in got) == [(1, "assign:2:17"), (2, ""), (2, "")]
    assert secrets.with_spans(docs.limit(0)).collect() == []
    words = secrets.dictionary(docs_of(spark, [(1, "zorble zorble understanding password=zorbleqq1", "en", "s", 1), (2, None, None, None, None)]))
    assert {"zorble", "understanding"} <= set(words.rank) and "zorbleqq" not in words.rank
    assert secrets.dictionary(docs.limit(0)).rank == secrets.BUILT_IN.rank
    with pytest.raises(FileNotFoundError):
        secrets.dictionary(docs.limit(0), "/no/such/vocabulary.json")
    shown = secrets.redact(docs.drop("spans")).collect()
    assert sorted((r.doc_id, str(r.text), str(r.n_chars)) for r in shown) == [(1, "é [SECRET]", "10"), (2, "", "0"), (2, "None", "None")]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.SQL[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
