"""Near duplicates by SimHash fingerprints and a Gray-order hierarchical index.

A text is lower-cased (A-Z), split into words at ASCII white space and read as its word shingles, repeats included; a
text with fewer words is one shingle, a text without words has fingerprint zero. A bit of the fingerprint is one if it
is set in over half of the shingles' XXH64 hashes. Fingerprints that differ in at most three bits are linked, and a
component is what links reach.

Only distinct fingerprints are searched. Two of them within three bits agree in one of four quarters of their bits, so
each is sent to its four quarters; a quarter's value with over ``GROUP`` fingerprints is divided again by quarters of
the remaining bits, as often as needed, and what is still too large then goes in pairs of chunks, so that a task never
holds a hot group. Inside a group the fingerprints are sorted by Gray rank, so neighbours share most bits; runs of them
form the nodes of a tree, each of which keeps the bits all its members share that its parent doesn't. A search goes
down with the differences summed so far and leaves a whole run once they exceed three. Links become one edge for each
fingerprint and group, towards the group's smallest member of its part, and the edges become components in rounds of
large and small stars, whose rows are cut through the shared folder. Rows of one fingerprint are dealt to several tasks
where they are many; the edges of a hub meet its one row of least neighbours in a join that adaptive execution splits.

Defined results: null text is an empty text; rows without ``doc_id`` take part in links, get the component of their
fingerprint, and never name one unless all members lack an id; repeated rows stay repeated. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import cut, join_unique, small_batches

SHINGLE = 3
MAX_BITS = 3
#: Fingerprints in one group of the index.
GROUP = 4096
#: Divisions of hot groups before chunks are paired.
LEVELS = 4
SEED = 42
_FAN = 8
_QUERIES = 256
_HASHES = 1 << 16


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned number."""
    tokens = (raw or b"").lower().split()  # of bytes: A-Z, and exactly the ASCII white space
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(tokens) - shingle + 1
    for at in range(0, n, _HASHES):
        some = [digest(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + _HASHES)].tolist(), ends[at + shingle - 1 : at + shingle - 1 + _HASHES].tolist())]
        total += _set_bits(np.array(some, "<u8"))
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingles by their hashes, as a signed number; zero without any."""
    total = sum((_set_bits(hashes[at : at + _HASHES]) for at in range(0, len(hashes), _HASHES)), np.zeros(64, np.int64))
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) of every row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def prints(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, shingle) for x in text], "<u8").view("<i8"))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), prints(F.col("text").cast("binary")).alias("fp"))


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each 64-bit value in the reflected Gray sequence."""
    rank = values.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class GrayIndex:
    """Runs of Gray-sorted fingerprints as nodes, level by level; group borders are never crossed."""

    def __init__(self, group: np.ndarray, values: np.ndarray) -> None:
        n = len(values)
        first = np.concatenate(([True], group[1:] != group[:-1])) if n else np.zeros(0, bool)
        begin = np.flatnonzero(first)
        place = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
        everything = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
        # each level: first item and end of its nodes, shared bits, their values, first child and end
        self.levels = [(np.arange(n), np.arange(n) + 1, everything, values, None, None)]
        both = either = values
        starts, width = np.arange(n), 1
        while n and len(starts) > len(begin):
            width *= _FAN
            own = np.flatnonzero(first | (place % width == 0))
            child = np.searchsorted(starts, own)
            both, either = np.bitwise_and.reduceat(both, child), np.bitwise_or.reduceat(either, child)
            shared = ~(both ^ either)
            self.levels.append((own, np.append(own[1:], n), shared, both & shared, child, np.append(child[1:], len(starts))))
            starts = own
        self.values = values
        self.root = np.cumsum(first) - 1

    def later_pairs(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j) of places within ``most`` bits and j after i in i's group, for i in ``queries``."""
        who, node = queries, self.root[queries]
        _, _, shared, pattern, _, _ = self.levels[-1]
        spent = np.bitwise_count((self.values[who] ^ pattern[node]) & shared[node]).astype(np.int64)
        for level in range(len(self.levels) - 2, -1, -1):
            _, _, above, _, child, end = self.levels[level + 1]
            _, until, shared, pattern, _, _ = self.levels[level]
            many = end[node] - child[node]
            own = shared[np.repeat(child[node] - np.cumsum(many) + many, many) + np.arange(many.sum())] & ~np.repeat(above[node], many)
            node = np.repeat(child[node] - np.cumsum(many) + many, many) + np.arange(many.sum())
            who, spent = np.repeat(who, many), np.repeat(spent, many)
            spent = spent + np.bitwise_count((self.values[who] ^ pattern[node]) & own)
            left = (spent <= most) & (until[node] > who + 1)
            who, node, spent = who[left], node[left], spent[left]
        return who, node


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merges the parts of ``label`` (each names its smallest place) that pairs i, j link."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, nxt := label[label]):
            label[:] = nxt


def _group_edges(group: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each value its part's representative, where that is another; groups are runs of equal ``group``."""
    order = np.lexsort((gray_rank(values), group))
    group, values = group[order], values[order]
    index, label = GrayIndex(group, values), np.arange(len(values))
    for at in range(0, len(values), _QUERIES):
        _join(label, *index.later_pairs(np.arange(at, min(len(values), at + _QUERIES)), most))
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def _edges(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Edges of sorted rows (path, val, part, fp); a group that a batch may have cut waits for the next."""
    waiting: list[pd.DataFrame] = []

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows[["path", "val", "part"]].to_numpy()
        group = np.cumsum(np.concatenate(([0], (keys[1:] != keys[:-1]).any(1)))) if len(rows) else np.zeros(0, int)
        several = np.bincount(group, minlength=1)[group] > 1
        a, b = _group_edges(group[several], rows["fp"].to_numpy()[several].astype(np.int64).view(np.uint64), most)
        a, b = a.view(np.int64), b.view(np.int64)
        return pd.DataFrame({"u": np.maximum(a, b), "v": np.minimum(a, b)})

    for rows in batches:
        if not len(rows):
            continue
        rows = pd.concat([*waiting, rows], ignore_index=True) if waiting else rows
        keys = rows[["path", "val", "part"]].to_numpy()
        last = int(np.flatnonzero((keys == keys[-1]).all(1))[0])
        waiting = [rows.iloc[last:]]
        if last:
            yield solve(rows.iloc[:last].reset_index(drop=True))
    if waiting:
        yield solve(pd.concat(waiting, ignore_index=True))


def _children(masks: list[tuple[int, int]]) -> list[list[int]]:
    """For each (path's bits, depth) the four larger bit sets that quarters of its other bits make."""
    out = []
    for bits, _ in masks:
        free = [b for b in range(64) if not bits >> b & 1]
        cuts = [round(q * len(free) / (MAX_BITS + 1)) for q in range(MAX_BITS + 2)]
        out.append([bits | sum(1 << b for b in free[cuts[q] : cuts[q + 1]]) for q in range(MAX_BITS + 1)])
    return out


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def near_edges(prints: DataFrame, most: int = MAX_BITS, group: int = GROUP, levels: int = LEVELS) -> DataFrame:
    """Edges (u > v) whose components are those of all pairs of distinct ``fp`` within ``most`` (0 to 3) bits."""
    small_batches(prints.sparkSession)
    rows, masks, done = prints.select("fp", F.lit(0).alias("path")), [(0, 0)], None
    for level in range(levels):
        nested = _children(masks)
        sets = F.array(*[F.array(*[F.lit(_signed(m)) for m in four]) for four in nested])
        rows = rows.select("fp", F.col("path").alias("up"), F.posexplode(F.get(sets, F.col("path"))).alias("quarter", "bits")).select(
            "fp", (F.col("up") * 4 + F.col("quarter")).alias("path"), F.col("fp").bitwiseAND(F.col("bits")).alias("val")
        )
        masks = [(m, level + 1) for four in nested for m in four]
        hot = cut(rows.groupBy("path", "val").count().filter(F.col("count") > group))
        if hot.isEmpty():
            some, rows = rows, None
        else:
            some = rows.join(hot, ["path", "val"], "left_anti")
            rows = cut(rows.join(hot, ["path", "val"]).select("fp", "path", "val", "count"))
        some = some.select("fp", "path", "val", F.lit(0).alias("part"))
        done = some if done is None else done.unionByName(some)
        if rows is None:
            break
        if level + 1 < levels:
            rows = rows.select("fp", "path")
    if rows is not None:  # pairs of chunks; two chunks together stay within a group
        chunks = F.ceil(F.col("count") * 2 / group).cast("int") + 1
        mine = F.pmod(F.xxhash64("fp"), chunks).cast("int")
        rows = rows.select("fp", "path", "val", chunks.alias("c"), mine.alias("m")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        pair = F.least("m", "o") * F.col("c") + F.greatest("m", "o") + 1
        done = done.unionByName(rows.select("fp", "path", "val", pair.cast("int").alias("part")))
    dealt = done.repartition("path", "val", "part").sortWithinPartitions("path", "val", "part")
    return dealt.mapInPandas(lambda it: _edges(it, most), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, its component's smallest node, for every node of edges (u > v) that isn't its root."""
    edges = cut(edges.distinct())
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        other = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(other.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest reachable doc_id)."""
    ids = cut(with_fingerprints(docs, shingle))
    prints = cut(ids.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    linked = components(near_edges(prints, most, group))
    named = prints.join(linked, prints.fp == linked.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    found = join_unique(ids, named, ["fp"], "fp", prints.select("fp", "n"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
