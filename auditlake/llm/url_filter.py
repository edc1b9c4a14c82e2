"""URL filtering by a trie over reversed host labels and path segments.

A rule is a host and a path prefix with a verdict, written ``example.org/en/1``. It fits its host and all subdomains
if the url's path starts with the rule's path. The longest fitting rule wins; among equally long ones the one with
the longer host, and a block over an allow.

The rules are walked as one trie: host labels from the last to the first, then path segments, and at each path node
the rules that end inside the next segment. A trie is broadcast and holds at most ``MAX_RULES`` rules. A longer list is
split into several tries; between two of them the urls with their best fit so far are written to the shared folder and
the trie is destroyed, so a task holds one trie at a time. With one trie the plan is map-only.

Defined results: a null url, or one without ``://``, has an empty host and path; no rule fits an empty path or an
unknown host, and then the default verdict holds. Ports and user names are part of the host. Repeated rows stay
repeated, an empty table gives no rows; further columns are carried, but those named host, path, rule or verdict in any
case are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import small_batches, stored

#: Rules in one broadcast trie.
MAX_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # host, path, verdict


def parse_rule(text: str, verdict: str) -> Rule:
    """``example.org/es/`` and a verdict as host, path and verdict; without a slash, the path is ``/``."""
    host, slash, path = text.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), "/" + path if slash else "/", verdict


class Trie:
    """host label -> ... -> path segment -> ... -> [(prefix of the next segment, rank, rule, verdict)]."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(0, {})  # 0: the paths of this host
            *whole, last = path[1:].split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            rank = (len(host) + len(path), len(host), verdict == "block")
            node.setdefault(0, []).append((last, rank, host + path, verdict))

    def best(self, host: str, path: str) -> tuple | None:
        """(rank, rule, verdict) of the fitting rule of the highest rank."""
        if not path.startswith("/"):
            return None
        found, node, segments = None, self.root, None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if 0 in node:
                segments = segments or path[1:].split("/")
                here = node[0]
                for segment in segments:
                    for last, rank, rule, verdict in here.get(0, ()):
                        if segment.startswith(last) and (found is None or rank > found[0]):
                            found = rank, rule, verdict
                    here = here.get(segment)
                    if here is None:
                        break
        return found


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def _fit(trie: Broadcast):  # noqa: ANN202
    """A column function: the best fit in one broadcast trie."""

    @F.pandas_udf("total int, wide int, block boolean, rule string, verdict string")
    def fit(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = [trie.value.best(h, p) for h, p in zip(host, path)]
        rows = [(*f[0], *f[1:]) if f else (-1, -1, False, None, None) for f in found]
        return pd.DataFrame(rows, columns=["total", "wide", "block", "rule", "verdict"])

    return fit


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url", max_rules: int = MAX_RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``."""
    spark = pages.sparkSession
    small_batches(spark)
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    out = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    for start in range(0, max(1, len(rules)), max_rules):
        trie = spark.sparkContext.broadcast(Trie(rules[start : start + max_rules]))
        fit = _fit(trie)("host", "path")
        out = out.withColumn("fit", F.greatest("fit", fit) if start else fit)
        if start + max_rules < len(rules):
            out = stored(out, "urls")
            trie.destroy()
    return out.select("row.*", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict"))
