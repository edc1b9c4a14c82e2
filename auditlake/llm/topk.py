"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are scaled to whole numbers and dealt by range of length to tables of blocks, so that a block holds vectors of
like length, longest first; a block is cut into buckets. Before all else the queries meet the longest block alone: the
k-th product found there is each query's floor, and travels with it to every other block. A block whose longest vector
cannot reach any query's floor is not joined with that query block at all.

In a block, a query's floor (or its k-th product so far, if that is higher) divided by the query's length and the
bucket's largest length is the local cosine threshold. Above 1, the bucket is left out. If it is low, length pruning:
only the vectors that are long enough are candidates. Otherwise coordinate pruning: products over the coordinates that
hold most of the bucket's energy, as many as leave the rest half the threshold or less, plus the product of the rests'
lengths bound the whole product, and only vectors whose bound reaches the floor are candidates. Candidates' products are
verified in whole numbers, those below the floor are dropped, and the best of each block meet in a window over the query.

The stated queries meet all rows in blocks: query blocks are copied to the vectors' slots and joined by slot. Blocks
have a fixed size in bytes, whatever the table's size.

Defined results: vectors that are null or have null or non-finite components take no part, nor rows without vec_id;
products of vectors of unlike length are not defined, so those don't meet; scaled components are cut at 2^62 in size
and scores at the range of a long. A query leaves out its own row alone: rows that repeat a vec_id are candidates of one
another, each asks, and each counts as often as it occurs. Ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import cut, small_batches

SCALE = 256
#: Bytes of a block of vectors and of a block of queries, bytes of vectors in a slot at least, and vectors in a bucket.
BLOCK_BYTES, QUERY_BYTES, SLOT_BYTES, BUCKET = 4 << 20, 1 << 18, 256 << 20, 1024
#: Local cosine from which coordinates prune.
COORDINATES_FROM = 0.2
_TOP = np.iinfo(np.int64).max
_NONE = np.iinfo(np.int64).min
_SLACK = 1e-9


def quantised(values: object, scale: int = SCALE) -> np.ndarray | None:
    """floor(scale * x) of each component as int64; none if a component is null or not finite."""
    if values is None:
        return None
    x = np.array([np.nan if v is None else v for v in values] if getattr(values, "dtype", object) == object else values, np.float64)
    if not np.isfinite(x).all():
        return None
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -(2.0**62), 2.0**62).astype("<i8")


def _packed(column: Column, scale: int) -> Column:
    @F.pandas_udf("dim int, norm double, vec binary")
    def pack(vectors: pd.Series) -> pd.DataFrame:
        found = [quantised(v, scale) for v in vectors]
        norms = [None if v is None else float(np.sqrt((v.astype(np.float64) ** 2).sum())) for v in found]
        return pd.DataFrame({"dim": pd.array([None if v is None else len(v) for v in found], "Int32"), "norm": norms, "vec": [None if v is None else v.tobytes() for v in found]})

    return pack(column)


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows sorted within partitions as blocks: dim, row numbers, ids and vectors as bytes, and the first one's length."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []

        def block() -> pd.DataFrame:
            number = lambda k: np.array([h[k] for h in held], "<i8").tobytes()
            out = pd.DataFrame({"dim": [held[0][0]], "rows": [number(1)], "ids": [number(2)], "vecs": [b"".join(h[3] for h in held)], "top": [held[0][4]]})
            held.clear()
            return out

        for rows in batches:
            for row in zip(rows["dim"].tolist(), rows["row"].tolist(), rows["vec_id"].tolist(), rows["vec"], rows["norm"].tolist()):
                if held and (held[0][0] != row[0] or len(held) * max(8, 8 * row[0]) >= most):
                    yield block()
                held.append(row)
        if held:
            yield block()

    return rows.select("dim", "row", "vec_id", "vec", "norm").mapInPandas(pack, "dim int, rows binary, ids binary, vecs binary, top double")


class Best:
    """The k best products of each query so far, from a floor on."""

    def __init__(self, floors: np.ndarray, k: int) -> None:
        self.k, self.floors, self.verified = k, floors, 0
        self.scores = [np.zeros(0, np.int64)] * len(floors)
        self.ids = [np.zeros(0, np.int64)] * len(floors)

    def least(self, q: int) -> int:
        """The product that a candidate must reach."""
        full = len(self.scores[q]) == self.k
        return max(int(self.floors[q]), int(self.scores[q][-1])) if full else int(self.floors[q])

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least(q)
        scores, ids = scores[good], ids[good]
        if len(scores) > self.k:
            good = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[good], ids[good]
        if not len(scores):
            return
        scores, ids = np.concatenate((self.scores[q], scores)), np.concatenate((self.ids[q], ids))
        # ~x falls as x rises and, unlike -x, holds for every long
        order = np.lexsort((ids, ~scores))[: self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]


def _exactly(queries: np.ndarray, vectors: np.ndarray) -> type:
    """A type in which inner products of these are whole and exact."""
    high = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
    return np.float64 if high < 2.0**52 else np.int64 if high < 2.0**62 else object


def _longs(exact: np.ndarray) -> np.ndarray:
    """Whole numbers cut at the range of a long."""
    return (np.clip(exact, _NONE, _TOP) if exact.dtype == object else exact).astype(np.int64)


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(1))


def _coordinate_candidates(queries: np.ndarray, some: np.ndarray, least: np.ndarray, cosine: float) -> np.ndarray:
    """For queries and vectors of a bucket, whether the product can reach each query's ``least``."""
    q, v = queries.astype(np.float64), some.astype(np.float64)
    energy = (v**2).sum(0)
    order = np.argsort(-energy, kind="stable")
    rest = 1 - np.cumsum(energy[order]) / max(float(energy.sum()), 1e-300)
    head = order[: 1 + int(np.searchsorted(-rest, -cosine / 2))]
    tail = order[len(head) :]
    bound = q[:, head] @ v[:, head].T + lengths(q[:, tail])[:, None] * lengths(v[:, tail])
    scale = lengths(q)[:, None] * float(lengths(v).max(initial=0))
    return bound >= least[:, None] - _SLACK * scale


def retrieve(query_rows: np.ndarray, queries: np.ndarray, floors: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, bucket: int = BUCKET) -> Best:
    """The k best of ``vectors`` (longest first) for each query, from its floor on and without its own row."""
    best = Best(floors, k)
    length, sizes = lengths(queries), lengths(vectors)
    for at in range(0, len(ids), bucket):
        some, own, their, norm = vectors[at : at + bucket], rows[at : at + bucket], ids[at : at + bucket], sizes[at : at + bucket]
        least = np.array([best.least(q) for q in range(len(queries))], np.float64)
        cosine = least / np.maximum(length * norm[0], 1e-300)
        cosine[least <= 0] = -1
        focus = np.flatnonzero((cosine >= COORDINATES_FROM) & (cosine <= 1 + _SLACK))
        exact = _exactly(queries, some)
        if len(focus):
            near = _coordinate_candidates(queries[focus], some, least[focus], float(np.median(cosine[focus])))
            wide = some.astype(exact)
            for q, mine in zip(focus.tolist(), near):
                left = np.flatnonzero(mine & (own != query_rows[q]))
                if len(left):
                    best.verified += len(left)
                    best.add(q, _longs(wide[left] @ queries[q].astype(exact)), their[left])
        by_length = []
        for q in np.flatnonzero(cosine < COORDINATES_FROM).tolist():
            long = len(norm) if least[q] <= 0 else int(np.searchsorted(-norm, -least[q] / max(length[q], 1e-300) * (1 - _SLACK), side="right"))
            if long:
                by_length.append((q, long))
        if by_length:
            deep = max(n for _, n in by_length)
            scores = _longs(queries[[q for q, _ in by_length]].astype(exact) @ some[:deep].astype(exact).T)
            for row, (q, n) in zip(scores, by_length):
                other = own[:n] != query_rows[q]
                best.verified += int(other.sum())
                best.add(q, row[:n][other], their[:n][other])
    return best


def _longs_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def _met(pair: dict, k: int) -> Best:
    """A query block meets a block of vectors."""
    asking, own = _longs_of(pair["query_rows"]), _longs_of(pair["rows"])
    queries, vectors = _longs_of(pair["queries"]).reshape(len(asking), pair["dim"]), _longs_of(pair["vecs"]).reshape(len(own), pair["dim"])
    return retrieve(asking, queries, _longs_of(pair["floors"]), own, _longs_of(pair["ids"]), vectors, k)


def _each(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for rows in batches:
        for at in range(len(rows)):
            yield rows.iloc[at].to_dict()


def _with_floors(queries: DataFrame, k: int) -> DataFrame:
    """Query blocks joined with the longest block, as query blocks with floors and the least length that reaches any."""

    def seed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pair in _each(batches):
            dim, many = pair["dim"], len(pair["query_rows"]) // 8
            best = _met(pair | {"floors": np.full(many, _NONE, "<i8").tobytes()}, k)
            floors = np.array([s[-1] if len(s) == k else _NONE for s in best.scores], "<i8")
            own = np.maximum(lengths(_longs_of(pair["queries"]).reshape(many, dim)), 1e-300)
            need = float(np.where(floors > 0, floors / own, 0.0).min(initial=np.inf)) * (1 - _SLACK)
            yield pd.DataFrame({"dim": [dim], "query_rows": [pair["query_rows"]], "query_ids": [pair["query_ids"]], "queries": [pair["queries"]], "floors": [floors.tobytes()], "need": [need]})

    return queries.mapInPandas(seed, "dim int, query_rows binary, query_ids binary, queries binary, floors binary, need double")


def top_k(vectors: DataFrame, asks: Column, k: int = 5, scale: int = SCALE, block_bytes: int = BLOCK_BYTES, query_bytes: int = QUERY_BYTES, shares: list | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row where ``asks`` holds, its k best among all other rows.

    ``shares``, where given, receives how many products were verified and how many pairs of a query and a row there are.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.filter(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), asks.alias("asks"), _packed(F.col("embedding"), scale).alias("p"))
    rows = cut(rows.select("vec_id", "asks", "p.*").filter("vec is not null").withColumn("row", F.monotonically_increasing_id()))
    size = rows.agg(F.sum(F.octet_length("vec")), F.sum(F.when(F.col("asks"), F.octet_length("vec")))).first()
    total = size[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // block_bytes))
    dealt = rows.repartitionByRange(tasks, "dim", F.desc("norm"), "vec_id").sortWithinPartitions("dim", F.desc("norm"), "vec_id")
    blocks = cut(_blocks(dealt, block_bytes).withColumn("part", F.monotonically_increasing_id()))
    slots = max(1, min(blocks.count(), max(2 * spark.sparkContext.defaultParallelism, total // SLOT_BYTES)))
    asking = _blocks(rows.filter("asks").repartition(1 + (size[1] or 0) // query_bytes).sortWithinPartitions("dim", "vec_id"), query_bytes)
    asking = asking.select("dim", F.col("rows").alias("query_rows"), F.col("ids").alias("query_ids"), F.col("vecs").alias("queries"))
    longest = blocks.join(blocks.groupBy("dim").agg(F.min("part").alias("part")), ["dim", "part"], "left_semi")
    verified = None if shares is None else spark.sparkContext.accumulator(0)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # one pair of blocks is several MB
    try:
        queries = cut(_with_floors(asking.join(longest, "dim").select("dim", "query_rows", "query_ids", "queries", "rows", "ids", "vecs"), k))
        queries = queries.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        blocks = blocks.withColumn("slot", F.pmod(F.xxhash64("part"), F.lit(slots)).cast("int"))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pair in _each(batches):
                best = _met(pair, k)
                if verified is not None:
                    verified.add(best.verified)
                found = [len(s) for s in best.scores]
                own = {x: np.repeat(_longs_of(pair[f"{x}s"]), found) for x in ("query_row", "query_id")}
                yield pd.DataFrame(own | {"vec_id": np.concatenate(best.ids), "score": np.concatenate(best.scores)})

        pairs = queries.join(blocks, ["slot", "dim"]).filter(F.col("top") >= F.col("need"))
        pairs = pairs.select("dim", "query_rows", "query_ids", "queries", "floors", "rows", "ids", "vecs")
        found = cut(pairs.mapInPandas(search, "query_row long, query_id long, vec_id long, score long"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    if shares is not None:
        met = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).agg(F.sum(F.col("q") * (F.col("n") - 1))).first()[0]
        shares[:] = [verified.value, met or 0]
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
