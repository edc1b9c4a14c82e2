"""Aliases in texts, found by keys, against the plain rule."""

import random
import re

from auditlake.operators import acquisition, containment


def plain(text, alias):
    low, name = text.lower(), alias.lower()
    return re.search(rf"(?<![a-z0-9]){re.escape(name)}(?![a-z0-9])", low) is not None if name.isascii() else name in low


def test_against_the_plain_rule(spark):
    rng = random.Random(7)
    pieces = ["tik", "tok", "Tik Tok", "ebay", "e", "a", "京东", "京", "é", "shop", "Shopée", "a.b", "ab", " ", "-", "9"]
    make = lambda n: "".join(rng.choices(pieces, k=rng.randrange(1, n)))
    texts = [make(7) for _ in range(120)] + ["", None, "tik tok", "tik toks", "x京东x", "İstanbul"]
    aliases = [(make(4), f"p{n % 9}") for n in range(30)] + [("", "none"), (None, "none"), ("Tik Tok", "t"), ("tik tok", "t"), ("e", "one"), ("京", "j"), ("shopée", "s")]
    rows = spark.createDataFrame([(x, n) for n, x in enumerate(texts)] + [(texts[0], 0)], "said string, n int")
    got = sorted(tuple(r) for r in containment.named(rows, spark.createDataFrame(aliases, "alias string, platform string"), "said").collect())
    want = {(t, n, p) for n, t in enumerate(texts) if t is not None for a, p in aliases if a and plain(t, a)}
    assert got == sorted(want) and len(got) > 50


def test_plan_and_empty_tables(spark):
    scopes = spark.createDataFrame([("Sales on tik tok",), ("none",)], "scope string")
    aliases = spark.createDataFrame([("TIK TOK", "t"), ("TikTok", "t")], "alias string, platform string")
    found = acquisition.named_platforms(scopes, aliases)
    assert found.collect() == [("Sales on tik tok", "t")] and "NestedLoop" not in found._jdf.queryExecution().toString()
    assert acquisition.named_platforms(scopes, aliases.limit(0)).collect() == [] and acquisition.named_platforms(scopes.limit(0), aliases).collect() == []
