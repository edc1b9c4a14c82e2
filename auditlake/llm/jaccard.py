"""Near copies for the pipeline: SimHash links, verified and completed on whole sets of word shingles.

A text is read as in ``simhash`` (A-Z lowered, words at ASCII white space), as the set of its five-word shingles' XXH64
hashes; a text with fewer words is one shingle, a text without words an empty set. Sets that are 0.8 alike or more are
linked, and a component is what links reach. At 0.8 two fingerprints of 64 bits differ in about ten, so the Gray index,
which searches three, cannot find all links: its edges are candidates, beside which shared shingles bring the others.

No link is left to chance: in any one order of all shingles, two sets that alike share a shingle among the first fifth of
each (and one more). The order puts shingles last that a sample finds often, so that a passage many texts share brings no
candidates; it decides the time, never the result. Only distinct sets are searched, in steps, so that a large group
of near copies is joined before its members meet each other: the index's edges and each set's first shared shingle; then
the members of a shingle that are in another component than its smallest or its largest set; then, in turns while many
pairs are left, each such set with a few members of the largest components of its shingles; then all pairs that are
still in different components, hot shingles in pairs of chunks, and only if sketches of their sets admit a link. A
candidate is dropped where the parities of its sets, about a bit for each shingle, differ in more places than sets that
are alike could; all others are verified on the whole sets, for which only the candidates' texts are read again.

Defined results: null text is empty; rows without doc_id take part; of a component one row stays, and equal rows count
as one. Further columns are carried whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import carried, cut, release, small_batches, stored
from auditlake.llm.simhash import SEED, components, majority, near_edges

SHINGLE = 5
#: Least similarity, as a fraction.
ALIKE = (4, 5)
#: One in so many texts is read for the order; shingles seen as often there go last, so many of them at most.
SAMPLE, SEEN, FREQUENT = 16, 4, 200_000
#: Members of a shingle in one chunk.
CHUNK = 1024
#: Members of larger components that a set meets in one turn, and turns at most; what they don't link is met by all pairs.
PIVOTS, TURNS = 8, 4
#: Places of a sketch.
SKETCH = 256
#: So many sets at most are sent to all tasks.
SMALL = 200_000


def shingles(raw: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's shingles."""
    tokens = (raw or b"").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(tokens), len(tokens) - shingle + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())], np.uint64))


def set_id(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def prefix(own: np.ndarray, frequent: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The first shingles in the common order, one of which any set that is alike shares; ``frequent`` is sorted."""
    if not len(own):
        return own
    rank = np.zeros(len(own), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        rank = np.where(frequent[at] == own, seen[at], 0)
    least = -(-ALIKE[0] * len(own) // ALIKE[1])
    return own[np.lexsort((own, rank))[: len(own) - least + 1]]


def parities(own: np.ndarray) -> bytes:
    """Parity of the shingles at each of 2^k places, 2^k from their number up; each shingle that two sets don't share changes one place."""
    places = 1 << max(6, (len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def sketch(own: np.ndarray) -> np.ndarray:
    """Parity of the shingles at each of ``SKETCH`` places, as longs: what the join of two members compares."""
    odd = np.bincount((own & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(bool)).view("<i8")


def may_be_alike(a: bytes, b: bytes, total: int) -> bool:
    """Whether sets of these parities, ``total`` shingles with repeats, can differ in as few shingles as sets that are alike."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)  # a place of fewer is the sum of those with the same low bits
    return int(np.bitwise_count(x ^ y).sum()) * sum(ALIKE) <= (ALIKE[1] - ALIKE[0]) * total


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the texts finds often, sorted, and how often."""

    @F.pandas_udf("array<long>")
    def all_of(text: pd.Series) -> pd.Series:
        return pd.Series([shingles(x).view(np.int64) for x in text])

    some = docs.select(F.col("text").cast("binary").alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).distinct()
    often = some.select(F.explode(all_of("text")).alias("s")).groupBy("s").count().filter(F.col("count") >= SEEN)
    rows = often.orderBy(F.desc("count"), "s").limit(FREQUENT).toPandas()
    hashes, seen = rows["s"].to_numpy(np.int64).view(np.uint64), rows["count"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], seen[order]


def _text_key() -> Column:
    """A number that equal texts share; where unlike texts do, their sets still tell them apart."""
    return F.xxhash64("text")


def with_sets(docs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` of every row with ``set`` (its id), ``size``, ``fp`` (fingerprint), ``prefix``, ``odd`` (parities), ``sketch`` and ``of`` (key of its text)."""
    small_batches(docs.sparkSession)
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs))

    @F.pandas_udf("set long, size int, fp long, prefix array<long>, odd binary, sketch array<long>")
    def read(text: pd.Series) -> pd.DataFrame:
        release()
        rows = []
        for raw in text:
            own = shingles(raw)
            rows.append((set_id(own), len(own), majority(own), prefix(own, *frequent.value).view(np.int64), parities(own), sketch(own)))
        return pd.DataFrame(rows, columns=["set", "size", "fp", "prefix", "odd", "sketch"])

    return docs.select(*columns, _text_key().alias("of"), read(F.col("text").cast("binary")).alias("r")).select("*", "r.*").drop("r")


def _whole(docs: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``set`` and ``all`` (its shingles as bytes) of the sets in ``pairs``; reads their texts alone."""

    @F.pandas_udf("set long, all binary")
    def read(text: pd.Series) -> pd.DataFrame:
        release()
        some = [shingles(x) for x in text]
        return pd.DataFrame({"set": np.array([set_id(s) for s in some], np.int64), "all": [s.tobytes() for s in some]})

    wanted = pairs.select(F.explode(F.array("u", "v")).alias("set")).distinct()
    wanted = cut(sets.select("set", "of").join(wanted, "set", "left_semi"))
    few = wanted.count() <= SMALL
    once = wanted.select("of").distinct()
    texts = docs.select(_text_key().alias("of"), F.col("text").cast("binary").alias("text")).join(F.broadcast(once) if few else once, "of", "left_semi")
    texts = texts.dropDuplicates(["of", "text"]).select(read("text").alias("r")).select("r.*")
    return stored(texts.join(F.broadcast(wanted) if few else wanted, "set", "left_semi").dropDuplicates(["set"]), "whole")


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets are alike."""

    @F.pandas_udf("boolean")
    def likely(a: pd.Series, b: pd.Series, total: pd.Series) -> pd.Series:
        release()
        return pd.Series([may_be_alike(*x) for x in zip(a, b, total)], dtype=bool)

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        release()
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both * ALIKE[1] >= ALIKE[0] * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    odd = sets.select("set", "size", "odd")
    a, b = odd.toDF("u", "m", "x"), odd.toDF("v", "n", "y")
    pairs = stored(pairs.join(a, "u").join(b, "v").filter(likely("x", "y", F.col("m") + F.col("n"))).select("u", "v"), "likely")
    whole = _whole(docs, pairs, sets)
    a, b = whole.select(F.col("set").alias("u"), F.col("all").alias("x")), whole.select(F.col("set").alias("v"), F.col("all").alias("y"))
    return pairs.join(a, "u").join(b, "v").filter(alike("x", "y")).select("u", "v")


def _hopeful(a: str, b: str) -> Column:
    """Whether two members of a shingle can be alike by their sizes, if it is the first that they share."""
    left = lambda s: F.col(f"{s}.size") - F.col(f"{s}.at")
    return F.least(left(a), left(b)) * sum(ALIKE) >= ALIKE[0] * (F.col(f"{a}.size") + F.col(f"{b}.size"))


def _differ(a: str, b: str) -> Column:
    """Places in which two sketches differ."""
    return sum((F.bit_count(F.col(f"{a}.k{n}").bitwiseXOR(F.col(f"{b}.k{n}"))) for n in range(SKETCH // 64)), F.lit(0))


def _unlike(a: str, b: str) -> Column:
    """Whether two sketches differ in more places than those of sets that are alike could."""
    return _differ(a, b) * sum(ALIKE) > (ALIKE[1] - ALIKE[0]) * (F.col(f"{a}.size") + F.col(f"{b}.size"))


def _pair(a: str, b: str) -> list[Column]:
    return [F.greatest(F.col(f"{a}.set"), F.col(f"{b}.set")).alias("u"), F.least(F.col(f"{a}.set"), F.col(f"{b}.set")).alias("v")]


def _by_fingerprint(sets: DataFrame) -> DataFrame:
    """Candidates of the Gray index: sets of one fingerprint with its smallest, and those of each edge between fingerprints."""
    first = cut(sets.groupBy("fp").agg(F.min("set").alias("first")))
    same = sets.select("set", "fp").join(first, "fp").filter("set <> first").select(F.col("set").alias("u"), F.col("first").alias("v"))
    edges = near_edges(first.select("fp"))
    name = lambda side: first.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_set"))
    other = edges.join(name("u"), "u").join(name("v"), "v").select(F.col("u_set").alias("u"), F.col("v_set").alias("v"))
    both = same.unionByName(other)
    return both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def linked(docs: DataFrame, sets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``node`` and ``root``, its component's smallest set, for every set that isn't its root; ``sets`` is distinct."""
    me = F.struct("set", "size", "at")
    dealt = sets.select("set", "size", F.posexplode("prefix").alias("at", "shingle")).repartition("shingle")
    several = dealt.groupBy("shingle").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).filter("lo <> hi")
    rows = stored(dealt.join(several.select("shingle"), "shingle", "left_semi"), "shared").select("shingle", me.alias("me"))

    def found(pairs: DataFrame, before: list[DataFrame]) -> DataFrame:
        """The pairs that no step before has met, verified."""
        for met in before:
            pairs = pairs.join(met, ["u", "v"], "left_anti")
        before.append(stored(pairs.distinct(), "met"))
        return cut(verified(before[-1], docs, sets))

    def parts(known: DataFrame) -> DataFrame:
        own = rows.join(known, F.col("me.set") == known.node, "left").select("shingle", "me", F.coalesce("root", "me.set").alias("part"))
        return stored(own, "parts")

    # the index's edges, and each set with the smallest of its first shared shingle
    met: list[DataFrame] = []
    ends = rows.groupBy("shingle").agg(F.min("me").alias("lo"))
    first = rows.join(ends, "shingle").groupBy("me.set").agg(F.min_by(F.struct("me", "lo"), F.col("me.at")).alias("f")).select("f.me", "f.lo").filter("me.set <> lo.set")
    edges = found(first.filter(_hopeful("me", "lo")).select(*_pair("me", "lo")).unionByName(_by_fingerprint(sets)), met)
    known = components(edges)

    # members that are in another part than the smallest or the largest of their shingle
    own = parts(known)
    ends = own.groupBy("shingle").agg(F.min(F.struct("me", "part")).alias("lo"), F.max(F.struct("me", "part")).alias("hi"), F.min("part").alias("x"), F.max("part").alias("y"))
    ends = own.join(ends.filter("x <> y"), "shingle").select("me", "part", F.explode(F.array("lo", "hi")).alias("end")).filter("part <> end.part")
    ends = ends.select("me", F.col("end.me").alias("end"))
    more = found(ends.filter(_hopeful("me", "end")).select(*_pair("me", "end")), met)
    if not more.isEmpty():
        edges = cut(edges.unionByName(more))
        known = components(edges)
        own = parts(known)

    longs = [F.col("sketch")[n].alias(f"k{n}") for n in range(SKETCH // 64)]
    sketches = sets.select("set", *longs)

    def uneven() -> DataFrame:
        """The members of shingles with several parts, with sketches, and ``n``, ``squares``: the members, and the sum of the parts' squares."""
        per = own.groupBy("shingle", "part").agg(F.count("*").alias("m"))
        groups = per.groupBy("shingle").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("squares"), F.count("*").alias("parts")).filter("n > 2 and parts > 1")
        some = own.join(groups.drop("parts"), "shingle").join(sketches, F.col("me.set") == F.col("set"))
        return some.select("shingle", "part", "n", "squares", F.struct("me.*", *[f"k{n}" for n in range(SKETCH // 64)]).alias("me"))

    # while more pairs are left than shared shingles: sets outside a shingle's largest parts and members of these, those of the likest sketches
    enough, first = rows.count(), 0
    for turn in range(TURNS):
        apart = stored(uneven(), "apart")
        pairs = apart.groupBy("shingle").agg(F.first(F.col("n") * F.col("n") - F.col("squares")).alias("pairs"))
        if (pairs.agg(F.sum("pairs")).first()[0] or 0) <= 2 * enough:
            break
        salt = F.xxhash64("me.set", "shingle", F.lit(turn))
        ends = apart.groupBy("shingle", "part", F.pmod(salt, F.lit(PIVOTS)).alias("salt")).agg(F.count("*").alias("m"), F.min_by("me", salt).alias("end"))
        ends = ends.groupBy("shingle", "salt").agg(F.max(F.struct("m", "part", "end")).alias("most")).select("shingle", "most.part", "most.end").alias("ends")
        near = apart.join(ends, "shingle").filter(apart.part != F.col("ends.part")).select("me", "end").filter(_hopeful("me", "end") & ~_unlike("me", "end"))
        likest = F.slice(F.array_sort(F.collect_set(F.struct(_differ("me", "end").alias("by"), F.col("end.set").alias("set")))), 1, PIVOTS)
        near = near.groupBy("me.set").agg(likest.alias("ends")).select(F.struct("set").alias("me"), F.explode("ends").alias("end"))
        more = found(near.select(*_pair("me", "end")), met)
        if not (links := more.count()):
            break
        edges = cut(edges.unionByName(more))
        known = components(edges)
        own = parts(known)
        first = first or links
        if 20 * links <= first:
            break

    # all that are still in different parts, in pairs of chunks
    own = uneven()
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = own.select("shingle", "me", "part", chunks.alias("c")).withColumn("m", F.pmod(F.xxhash64("me.set"), F.col("c")).cast("int"))
    own = own.select("shingle", "me", "part", "c", "m", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("o"))
    a = own.select("shingle", F.col("m").alias("i"), F.col("o").alias("j"), F.col("me").alias("a"), F.col("part").alias("p"))
    b = own.select("shingle", F.col("o").alias("i"), F.col("m").alias("j"), F.col("me").alias("b"), F.col("part").alias("q"))
    rest = a.join(b, ["shingle", "i", "j"]).filter("a.set < b.set and p <> q").filter(_hopeful("a", "b") & ~_unlike("a", "b")).select(*_pair("a", "b"))
    more = found(rest, met)
    return known if more.isEmpty() else components(edges.unionByName(more))


def row_key(docs: DataFrame) -> Column:
    """A key of a row's whole content; rows that share it are equal."""
    return F.unhex(F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), {"ignoreNullFields": "false"})))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with exactly one row of each component: that of the smallest doc_id, of these the smallest by row key.

    Rows without a doc_id come after all others of their component. The rows that go, and those that equal another, are
    named by their keys; up to ``SMALL`` names are sent to all tasks, so that no text is shuffled but of equal rows.
    """
    ids = stored(with_sets(docs, row_key(docs).alias("key"), F.col("doc_id").cast("long").alias("doc_id")), "sets")
    found = linked(docs, stored(ids.drop("key", "doc_id").dropDuplicates(["set"]), "distinct"))
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")
    best = ids.groupBy("set").agg(F.min(order).alias("best"))
    best = best.join(found, best.set == found.node, "left").groupBy(F.coalesce("root", "set").alias("root")).agg(F.min("best").alias("best"))
    keys = ids.groupBy("key").agg(F.count("*").alias("n"))
    marks = keys.join(best.select(F.col("best.key").alias("key"), F.lit(True).alias("stays")), "key", "left").filter("stays is null or n > 1")
    marks = cut(marks.select("key", F.col("stays").isNotNull().alias("equals")))
    if marks.count() <= SMALL:
        marks = F.broadcast(marks)
    rows = docs.select(carried(docs), row_key(docs).alias("key")).join(marks, "key", "left")
    once = rows.filter("equals").dropDuplicates(["key"])
    return rows.filter("equals is null").unionByName(once).select("row.*")
