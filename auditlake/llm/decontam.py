"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Words are runs of letters and digits, lower-cased. First, all documents are counted: for each n-gram of the benchmark,
in how many documents it occurs. Along each item, the rarest n-gram of every few neighbours becomes a seed, so a common
phrase is a seed only where everything around it is common, and any unchanged run of ``GRAM + WINDOW - 1`` words holds
a seed, however often it occurs in the corpus. Where a document has an item's seed, the stretch of the document around
it is aligned with the item word by word (Smith-Waterman: +2 for a match, -1 for another word, a gap or an insertion),
so edited and paraphrased copies score too. A stretch whose words cannot reach the threshold is left out before that.
Every copy of an item in a document is returned: beside a found one, both sides are aligned again.

Documents are never shuffled: both passes only read them, and the index of the benchmark is broadcast. Items are taken
in blocks of at most ``BLOCK_GRAMS`` n-grams, each of which passes through the driver and has its own two passes;
between two blocks the matches so far are written to the shared folder and the index is destroyed, so that a task, and
the driver, hold one index at a time.

Defined results: null text or item is empty; an item without words matches nothing, one of fewer than ``LEAST`` words,
which has no n-gram, wherever a document has its very words in a row; a row without doc_id is searched like any other; rows and items that repeat are
searched as often as they occur. Further columns are carried by ``with_matches`` and ``clean`` whatever their names; one
named like the matches is replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import carried, release, small_batches, stored

GRAM = 3
WINDOW = 3
#: Items of fewer words are found as they are.
LEAST = 3
#: Alignment score of a contaminated document, as a part of the item's own.
THRESHOLD = 0.5
#: n-grams of the benchmark in one broadcast index.
BLOCK_GRAMS = 500_000
MATCH, OTHER, GAP = 2, -1, -1
WORD = re.compile(r"[^\W_]+")
_DOCS = 64
SCHEMA = "array<struct<item_id:long,score:double,first:long,last:long>>"


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Index:
    """Vocabulary, n-grams and seeds of a block of items."""

    def __init__(self, items: list[tuple[int, list[str]]]) -> None:
        self.word: dict[str, int] = {}
        for _, words in items:
            for w in words:
                self.word.setdefault(w, len(self.word))
        self.base = len(self.word) + 1
        self.short: dict[int, dict[int, list[int]]] = {n: defaultdict(list) for n in range(1, LEAST)}
        for i, words in items:
            if len(words) < LEAST:
                self.short[len(words)][int(self.grams(np.array([self.word[w] for w in words], np.int64), len(words))[0])].append(i)
        items = [x for x in items if len(x[1]) >= LEAST]
        self.ids = [i for i, _ in items]
        self.items = [np.array([self.word[w] for w in words], np.int64) for _, words in items]
        self.keys = [self.grams(x) for x in self.items]
        self.gram = np.unique(np.concatenate([*self.keys, np.zeros(0, np.int64)]))
        self.seed_key = np.zeros(0, np.int64)

    def grams(self, x: np.ndarray, size: int = GRAM) -> np.ndarray:
        """A number for each n-gram; -1 where a word isn't in the vocabulary."""
        n = len(x) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        key, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(size):
            part = x[k : k + n]
            key = key * self.base + part
            known &= part >= 0
        return np.where(known, key, -1)

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of several texts with gaps between them, where each begins, and its number of words."""
        get, flat, begin, many = self.word.get, [], [], []
        for text in texts:
            words = tokens(text)
            begin.append(len(flat))
            many.append(len(words))
            flat.extend([get(w, -1) for w in words])
            flat.append(-1)
        return np.array(flat, np.int64), np.array(begin, np.int64), np.array(many, np.int64)

    def hits(self, flat: np.ndarray, keys: np.ndarray, size: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
        """Places of n-grams that are among the sorted ``keys``, and which."""
        own = self.grams(flat, size)
        at = np.flatnonzero(own >= 0)
        if not len(at) or not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(keys, own[at]), len(keys) - 1)
        good = keys[place] == own[at]
        return at[good], place[good]

    def runs(self, flat: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Items of few words wherever they stand: item, first and last place."""
        for size, items in self.short.items():
            keys = np.array(sorted(items), np.int64)
            for place, which in zip(*(x.tolist() for x in self.hits(flat, keys, size))):
                for item in items[int(keys[which])]:
                    yield item, place, place + size - 1

    def choose(self, documents: np.ndarray) -> None:
        """Seeds: of every ``WINDOW`` neighbours the n-gram in the fewest documents, the leftmost of equals."""
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, keys in enumerate(self.keys):
            rare = documents[np.searchsorted(self.gram, keys)]
            chosen = {a + int(np.argmin(rare[a : a + WINDOW])) for a in range(max(0, len(keys) - WINDOW) + 1)} if len(keys) else set()
            for place in chosen:
                seeds[int(keys[place])].append((item, place))
        self.seed_key = np.array(sorted(seeds), np.int64)
        self.seed_at = [seeds[k] for k in self.seed_key.tolist()]

    def matches(self, words: np.ndarray, at: list[int], which: list[int], threshold: float) -> list[tuple[int, float, int, int]]:
        """(item, score, first and last word) of each copy that the document's words hold."""
        spans: dict[int, list[list[int]]] = defaultdict(list)
        for place, seed in zip(at, which):
            for item, offset in self.seed_at[seed]:
                size = len(self.items[item])
                low, high = max(0, place - offset - size // 2 - 4), min(len(words), place - offset + size + size // 2 + 4)
                runs = spans[item]
                if runs and low <= runs[-1][1]:
                    runs[-1][1] = max(high, runs[-1][1])
                    runs[-1][0] = min(low, runs[-1][0])
                else:
                    runs.append([low, high])
        out = []
        for item, runs in sorted(spans.items()):
            query = self.items[item]
            need = threshold * MATCH * len(query)
            while runs:
                low, high = runs.pop()
                part = words[low:high]
                if MATCH * min(int(np.isin(part, query).sum()), int(np.isin(query, part).sum())) < need:
                    continue
                score, last = align(query, part)
                if score >= need:
                    _, length = align(query[::-1], part[: last + 1][::-1])
                    out.append((self.ids[item], score / (MATCH * len(query)), low + last - length, low + last))
                    runs += [[low, low + last - length], [low + last + 1, high]]
        return sorted(out, key=lambda m: (m[0], m[2]))


def align(query: np.ndarray, part: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score and the last place in ``part`` that it takes (the first of equals)."""
    steps = np.arange(len(part) + 1) * -GAP
    row, best, where = np.zeros(len(part) + 1, np.int64), 0, -1
    for word in query:
        step = np.zeros_like(row)
        step[1:] = np.maximum(row[:-1] + np.where(part == word, MATCH, OTHER), row[1:] + GAP)
        # a gap in the query costs the same at each place, so a running maximum closes all of them at once
        row = np.maximum(np.maximum.accumulate(np.maximum(step, 0) + steps) - steps, 0)
        top = int(row.max())
        if top > best:
            best, where = top, int(row.argmax()) - 1
    return best, where


def _blocks(benchmark: DataFrame, most: int) -> Iterator[Index]:
    items, grams = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        words = tokens(row["text"])
        if not words:
            continue
        if items and grams + len(words) > most:
            yield Index(items)
            items, grams = [], 0
        items.append((row["item_id"], words))
        grams += len(words)
    if items:
        yield Index(items)


def gram_documents(docs: DataFrame, index: Index) -> np.ndarray:
    """In how many documents each of the index's n-grams occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        total = np.zeros(len(index.gram), np.int64)
        for rows in batches:
            release()
            texts = rows["text"].tolist()
            for a in range(0, len(texts), _DOCS):
                flat, begin, _ = index.read(texts[a : a + _DOCS])
                at, which = index.hits(flat, index.gram)
                doc = np.searchsorted(begin, at, side="right") - 1
                once = np.unique(doc * len(index.gram) + which) % max(1, len(index.gram))
                total += np.bincount(once, minlength=len(total))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"gram": some, "n": total[some]})

    counted = docs.select("text").mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(len(index.gram), np.int64)
    for row in counted.collect():  # a row for each n-gram of the block at most
        out[row["gram"]] = row["n"]
    shared.destroy()
    return out


def _search(shared: Broadcast, threshold: float):  # noqa: ANN202
    """A column function: the copies of a broadcast index's items in each text."""

    @F.pandas_udf(SCHEMA)
    def search(column: pd.Series) -> pd.Series:
        release()
        index, texts, found = shared.value, column.tolist(), []
        for a in range(0, len(texts), _DOCS):
            flat, begin, many = index.read(texts[a : a + _DOCS])
            at, which = index.hits(flat, index.seed_key)
            own: dict[int, list[int]] = defaultdict(list)
            for n, d in enumerate((np.searchsorted(begin, at, side="right") - 1).tolist()):
                own[d].append(n)
            few: dict[int, list[tuple[int, float, int, int]]] = defaultdict(list)
            for item, first, last in index.runs(flat):
                d = int(np.searchsorted(begin, first, side="right")) - 1
                few[d].append((item, 1.0, first - int(begin[d]), last - int(begin[d])))
            for d in range(len(begin)):
                some = few.get(d, [])
                if hits := own.get(d):
                    words = flat[begin[d] : begin[d] + many[d]]
                    some += index.matches(words, (at[hits] - begin[d]).tolist(), which[hits].tolist(), threshold)
                found.append([dict(zip(("item_id", "score", "first", "last"), x)) for x in some])
        return pd.Series(found, dtype=object)

    return search


def with_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK_GRAMS, name: str = "matches") -> DataFrame:
    """``docs`` with ``matches``: for each copy of an item its id, score (0 to 1) and the first and last word of the copy."""
    spark = docs.sparkSession
    small_batches(spark)
    out, shared = docs.select(carried(docs, name), "text", F.array().cast(SCHEMA).alias("found")), None
    for index in _blocks(benchmark, block):
        if shared is not None:
            out = stored(out, "matches")
            shared.destroy()
        index.choose(gram_documents(docs, index))
        shared = spark.sparkContext.broadcast(index)
        out = out.withColumn("found", F.concat("found", _search(shared, threshold)("text")))
    return out.select("row.*", F.col("found").alias(name))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, first_word and last_word of every copy of an item in a document."""
    found = with_matches(docs.select("doc_id", "text"), benchmark, threshold)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.score", F.col("m.first").alias("first_word"), F.col("m.last").alias("last_word"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that hold a copy of an item."""
    found = with_matches(docs.select(carried(docs), "text"), benchmark, threshold)
    return found.filter(F.size("matches") == 0).select("row.*")
