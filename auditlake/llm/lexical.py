"""Ranked lexical search: WAND in each shard of documents, and a merge of the shards' heaps.

Terms are runs of ASCII letters and digits and of all other characters beyond ASCII; only A-Z are lower-cased. One pass
over the documents writes, for each, its number of terms and how often it holds each term that an item asks for; texts
are never shuffled. From this table come the corpus's counts (documents, terms, documents of a term) and the shards: a
shard is what one task reads of it, taken up in blocks of whole documents.

In a block, the postings of a term are sorted by document, with the impact of each (its summand of the score) and the
largest one. An item's cursors are sorted by document; the pivot is the first document at which the largest impacts of
the cursors so far add up to the heap's least score. Cursors before it are moved there by bisection, so documents in
between are never looked at; a document is scored where all cursors before the pivot have reached it. The heap stays
with the item from block to block, so later blocks begin with a high threshold. Shards' heaps are merged by windows, in
two steps, so that no item's rows from all shards are sorted in one task.

Items are taken in blocks of about ``BLOCK_TERMS`` terms, each with passes of its own, so that the broadcast index and
what passes through the driver have a fixed size, whatever the number of items.

Defined results: null texts have no terms; documents without terms count in nothing; each row of documents and of items
counts by itself, so an item_id that repeats is ranked as often, and rows that repeat a doc_id each take a rank. A row
without doc_id takes part and comes last among equal scores. Sums beyond a long are an error, not a cut.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import small_batches, stored

#: Terms of items in one broadcast index, and postings in a block of documents.
BLOCK_TERMS, BLOCK_POSTINGS = 500_000, 2_000_000
#: Merges of shards before the last one.
MERGES = 256
_LETTERS = bytes(range(48, 58)) + bytes(range(97, 123))
#: Bytes to bytes: letters lower-cased, what is no part of a term to spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _LETTERS else 32 for c in range(256))
_LAST = 2**63
_POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"


def terms(raw: bytes | None) -> list[bytes]:
    """The terms of a text's UTF-8, in order."""
    return raw.translate(_TABLE).split() if raw else []


def weight(documents: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


def impacts(weights: np.ndarray, tfs: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return weights * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * norms))


class Block:
    """An inverted index over some documents."""

    def __init__(self, ids: list, norms: np.ndarray, sizes: np.ndarray, words: np.ndarray, tfs: np.ndarray, weights: np.ndarray) -> None:
        self.ids = ids
        doc = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(words, kind="stable")
        words, self.doc = words[order], doc[order]
        self.impact = impacts(weights[words], tfs[order].astype(np.int64), norms[self.doc])
        self.words, first = np.unique(words, return_index=True)
        self.ends = np.append(first, len(words))
        self.most = np.maximum.reduceat(self.impact, first) if len(words) else np.zeros(0, np.int64)
        self.place = {w: n for n, w in enumerate(self.words.tolist()) if self.most[n] > 0}
        self.read: dict[int, tuple[list[int], list[int], int]] = {}

    def postings(self, word: int) -> tuple[list[int], list[int], int] | None:
        """Documents (and one beyond the last), their impacts, and the largest impact; none if no document gains by it."""
        at = self.place.get(word)
        if at is None:
            return None
        if word not in self.read:
            low, high = self.ends[at], self.ends[at + 1]
            self.read[word] = [*self.doc[low:high].tolist(), len(self.ids)], self.impact[low:high].tolist(), int(self.most[at])
        return self.read[word]

    def search(self, words: list[int], heap: list[tuple[int, int]], k: int) -> int:
        """Brings the item's heap of (score, -doc_id) up to date; returns how many documents were scored."""
        lists = [x for w in words if (x := self.postings(w))]
        many, end, scored = len(lists), len(self.ids), 0
        if not many:
            return 0
        docs, gains, bounds = zip(*lists)
        at = [0] * many
        cursors = [d[0] * many + j for j, d in enumerate(docs)]  # document and list in one number, which sorts fast
        while True:
            cursors.sort()
            least = heap[0][0] if len(heap) == k else 1
            bound = 0
            for before, cursor in enumerate(cursors):  # noqa: B007
                bound += bounds[cursor % many]
                if bound >= least:
                    break
            else:
                return scored
            pivot = cursor // many
            if pivot == end:
                return scored
            if cursors[0] // many < pivot:
                for n in range(before):
                    j = cursors[n] % many
                    at[j] = bisect_left(docs[j], pivot, at[j])
                    cursors[n] = docs[j][at[j]] * many + j
                continue
            score = 0
            for n, cursor in enumerate(cursors):
                if cursor // many != pivot:
                    break
                j = cursor % many
                score += gains[j][at[j]]
                at[j] += 1
                cursors[n] = docs[j][at[j]] * many + j
            scored += 1
            own = (score, -(_LAST if self.ids[pivot] is None else self.ids[pivot]))
            if len(heap) < k:
                heappush(heap, own)
            elif own > heap[0]:
                heapreplace(heap, own)


def _asked(items: DataFrame) -> DataFrame:
    """Each item's row number, id and distinct terms."""

    @F.pandas_udf("array<binary>")
    def distinct(texts: pd.Series) -> pd.Series:
        return texts.map(lambda raw: sorted(set(terms(raw))))

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), distinct(F.col("text").cast("binary")).alias("terms"))
    return stored(rows.filter(F.size("terms") > 0).withColumn("row", F.monotonically_increasing_id()), "items")


def _held(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Each document's number of terms, and of which terms of the vocabulary it holds how many."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for rows in batches:
            n, sizes, which, often = [], [0], [], []
            for raw in rows.column("raw").to_pylist():
                found = terms(raw)
                n.append(len(found))
                for term, times in Counter(found).items():
                    if (number := known.get(term)) is not None:
                        which.append(number)
                        often.append(times)
                sizes.append(len(which))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int32())) for x in (which, often)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return stored(rows.mapInArrow(read, _POSTINGS).filter("n > 0"), "postings")


def _heaps(held: DataFrame, asked: dict[int, list[int]], weights: np.ndarray, k: int) -> DataFrame:
    """From each shard, each item's best documents: row, doc_id, score."""
    shared = held.sparkSession.sparkContext.broadcast((asked, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = shared.value
        heaps: dict[int, list[tuple[int, int]]] = {row: [] for row in asked}
        waiting: list[pa.RecordBatch] = []

        def work() -> None:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            lists = rows.column("terms").combine_chunks()
            block = Block(rows.column("doc_id").to_pylist(), rows.column("m").to_numpy(), lists.value_lengths().to_numpy(), lists.flatten().to_numpy(), rows.column("tfs").combine_chunks().flatten().to_numpy(), weights)
            for row, words in asked.items():
                block.search(words, heaps[row], k)
            waiting.clear()

        postings = 0
        for rows in batches:
            if rows.num_rows:
                waiting.append(rows)
                postings += len(rows.column("terms").flatten())
                if postings >= BLOCK_POSTINGS:
                    work()
                    postings = 0
        if waiting:
            work()
        best = [(row, None if minus == -_LAST else -minus, score) for row, heap in heaps.items() for score, minus in heap]
        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in best], pa.int64()) for n in range(3)], ["row", "doc_id", "score"])

    return held.mapInArrow(search, "row long, doc_id long, score long")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best of each item's rows, with their ranks."""
    best = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("row", "part").orderBy(*best)
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(MERGES)))
    found = found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k).drop("part", "rank")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*best))).filter(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: each item's ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    small_batches(spark)
    asked = _asked(items)
    most, out = asked.agg(F.sum(F.size("terms"))).first()[0] or 0, None
    blocks = -(-most // block)
    for number in range(blocks):
        vocabulary: dict[bytes, int] = {}
        rows = {}
        for row in asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number).select("row", "terms").toLocalIterator():  # a block at a time
            rows[row["row"]] = [vocabulary.setdefault(bytes(t), len(vocabulary)) for t in row["terms"]]
        held = _held(docs, vocabulary)
        documents, total = held.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            break
        having = np.zeros(len(vocabulary), np.int64)
        for row in held.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # a row for each term of the block at most
            having[row["term"]] = row["count"]
        weights = np.array([weight(documents, n) for n in having.tolist()], np.int64)
        held = held.select("doc_id", F.expr(f"10L + (90L * n * {documents}L) div {total}L").alias("m"), "terms", "tfs").filter(F.size("terms") > 0)
        best = _merged(_heaps(held, rows, weights, k), k)
        best = stored(best, "ranked") if blocks > 1 else best
        out = best if out is None else out.unionByName(best)
    if out is None:
        return asked.limit(0).select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return out.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")
