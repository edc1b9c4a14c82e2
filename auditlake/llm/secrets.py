"""Secret scans: fixed patterns, and values of credential contexts by their guess cost.

Three patterns always count: assignments to a password, secret, token or API key, access ids, and long hexadecimal
runs. Beside them, values in wider credential contexts (other names, other separators, characters outside the fixed
pattern, user information in URLs) are judged by what a guesser would pay: dynamic programming finds the cheapest
segmentation of the value into dictionary words (with capitals and substituted letters), dates, repeats, keyboard walks
and brute-force characters; the logarithms of the guesses add up, and from ``GUESSES`` on the value is a secret.

The segmentation is a true minimum over all pieces of all lengths, in time near linear in the value. A walk is priced
step by step, so its price is carried along. A repeat's price grows with the logarithm of its copies; of two starts in
one run, the later one is followed only while it is the cheaper of the two. Places that cost as much as the limit are
left, and with none cheaper ahead the search ends.

The dictionary's ranks come from the corpus itself: words of all texts, outside credential values, by how often they
occur, after a fixed list of password words; a vocabulary file of a tokenizer, where one is named, adds words of its
language in its own order, and is an error where it is not there. All words are counted; the guesser that is modelled
knows the ``DICTIONARY`` commonest ones, and rarer words, which would cost it 10^4.7 guesses and more, are priced by
their pieces. So what is broadcast does not grow with the corpus, and spans depend on the documents alone.

Spans are (kind, start, end) in code points, the end exclusive. Of the fixed patterns the span is the whole match, of
the guessed values the value; a value inside a fixed pattern's span is not named twice.

Defined results: null text is empty and has no spans. Whole texts are scanned. Repeated rows stay repeated; further
columns are carried by ``with_spans`` and ``redact``; a column with the name of the spans is replaced.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import cut, release, small_batches
from auditlake.operators.common import placed

#: Logarithm to base 10 of the guesses from which a value is a secret.
GUESSES = 10.0
KINDS = ("assign", "access", "hex", "guess")
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
VALUE_LENGTH = 6

CONTEXT = re.compile(
    r"""(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|(?:[a-z]+[_-])?secret|(?:[a-z]+[_-])?token|credentials?|auth(?:orization)?"""
    r"""|(?:api|access|private|secret|session|signing|encryption)[_-]?key)["'\]]?\s*(?:=>|:=|={1,2}|:)\s*(?:(?:bearer|basic)\s+)?["']?([^\s"'<>`,;]{6,})""",
    re.I | re.A,
)
USERINFO = re.compile(r"://[^\s:/@?#]*:([^\s/@]{6,})@")
#: One of these is in every context, in lower case.
HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "key")

# Words of passwords and of settings, the commonest first.
WORDS = (
    "password admin welcome login letmein master dragon monkey shadow sunshine princess football baseball superman batman"
    " qwerty trustno iloveyou hello freedom whatever starwars computer internet secret summer winter spring autumn monday"
    " friday january february march april may june july august september october november december test guest root user"
    " default changeme example sample demo temp public private access security system server database service account"
    " company office home love house orange purple yellow silver golden black white green blue red cat dog tiger eagle"
    " hunter ranger soccer hockey jordan michael thomas george charlie andrew daniel jessica ashley jennifer joshua robert"
    " matrix cookie banana cheese coffee pepper ginger flower killer angel junior pass word key token value string true"
    " false none null required optional your my the and for with here insert replace todo unknown undefined placeholder"
).split()
# Letters that substitutes stand for.
PLAIN = str.maketrans("4@310$5+7!8", "aaeiossttib")
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d|(?:19|20)\d\d)")


#: Words of the corpus, and of a vocabulary file, in a dictionary.
DICTIONARY = 50_000
#: Lengths of dictionary words.
SHORTEST, LONGEST = 3, 24
#: Logarithms of the guesses: where a walk begins, a step straight on, any other step; a year, a full date.
START, STRAIGHT, TURN, YEAR, DAY = math.log10(47), 0.1, 0.6, 2.0, 4.3
#: Longest unit of a repeat.
UNITS = 4
_FLUSH = 200_000
_LETTERS = re.compile(r"[^\W\d_]+")


def _steps() -> dict[str, int]:
    """Directions between keys: in a row, and to the rows above and below at half a key's shift."""
    place = {c: (r, k) for r, row in enumerate(KEYBOARD) for k, c in enumerate(row)}
    at = {v: c for c, v in place.items()}
    near = ((0, -1), (0, 1), (-1, 0), (-1, 1), (1, -1), (1, 0))
    return {c + at[r + a, k + b]: n for c, (r, k) in place.items() for n, (a, b) in enumerate(near) if (r + a, k + b) in at}


STEPS = _steps()


class Dictionary:
    """Words by rank, the commonest first, and which lengths occur after the same first letters."""

    def __init__(self, words: Iterable[str] = ()) -> None:
        self.rank: dict[str, float] = {}
        lengths = defaultdict(set)
        for word in (*WORDS, *words):
            if SHORTEST <= len(word) <= LONGEST and word not in self.rank:
                self.rank[word] = math.log10(len(self.rank) + 2)
                lengths[word[:SHORTEST]].add(len(word))
        self.lengths = {head: tuple(sorted(some)) for head, some in lengths.items()}

    def price(self, piece: str) -> float:
        """Logarithm of the guesses of a word, more for capitals and substitutes; infinite for other pieces."""
        low = _lower(piece)
        plain = low.translate(PLAIN)
        rank = min(self.rank.get(low, math.inf), self.rank.get(plain, math.inf) + 0.5 * sum(map(str.__ne__, low, plain)))
        capitals = sum(map(str.isupper, piece))
        if not capitals or rank == math.inf:
            return rank
        usual = capitals == len(piece) or capitals == 1 and piece[0].isupper()
        return rank + 0.3 + (0.0 if usual else 0.5 * min(capitals, len(piece) - capitals))


BUILT_IN = Dictionary()


def _lower(value: str) -> str:
    """Lower case with as many characters."""
    low = value.lower()
    return low if len(low) == len(value) else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


def _copies(value: str) -> list[tuple[int, list[int]]]:
    """For each unit length that repeats, how many copies of the unit begin at each place; 0 where a shorter unit tells the same."""
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4")
    n, same, out = len(codes), {}, []
    for unit in range(1, UNITS + 1):
        if n < 2 * unit:
            break
        same[unit] = codes[:-unit] == codes[unit:]
        ends = np.append(np.flatnonzero(~same[unit]), n - unit)
        times = 1 + (ends[np.searchsorted(ends, np.arange(n - unit))] - np.arange(n - unit)) // unit
        times[times < max(2, -(-SHORTEST // unit))] = 0
        for shorter in range(1, unit):
            if unit % shorter == 0:
                inner = np.ones(n - unit, bool)
                for k in range(unit - shorter):
                    inner &= same[shorter][k : k + n - unit]
                times[inner] = 0
        if times.any():
            out.append((unit, times.tolist() + [0] * unit))
    return out


def guess_cost(value: str, words: Dictionary = BUILT_IN, most: float = math.inf) -> float:
    """Logarithm to base 10 of the guesses of the cheapest segmentation; anything from ``most`` on if that costs as much."""
    n, low, inf = len(value), _lower(value), math.inf
    plain = low.translate(PLAIN)
    plain = None if plain == low else plain
    cost, walk, reach = [0.0] + [inf] * n, inf, 0  # reach: the last place below most
    known = {c: _brute(c) for c in set(value)}
    brute = [known[c] for c in value]
    copies, rank, lengths, runs = _copies(value), words.rank, words.lengths, {}
    step = None  # direction from the key before the last to the last
    for i in range(n + 1):
        if i > reach + SHORTEST:
            return inf
        if i >= 2:
            before, step = step, STEPS.get(low[i - 2 : i])
            if step is None or before is None:
                walk = inf
            else:
                walk = min(walk, cost[i - 3] + START + TURN) + (STRAIGHT if step == before else TURN)
                if walk < cost[i]:
                    cost[i] = walk
                    if walk < most and i > reach:
                        reach = i
        here = cost[i]
        if here >= most or i == n:
            continue
        ends = [(i + 1, brute[i])]
        sizes = lengths.get(low[i : i + SHORTEST], ())
        if plain:
            sizes = {*sizes, *lengths.get(plain[i : i + SHORTEST], ())}
        for size in sizes:
            if i + size <= n and (low[i : i + size] in rank or plain and plain[i : i + size] in rank):
                ends.append((i + size, words.price(value[i : i + size])))
        if "0" <= value[i] <= "9":
            ends += [(i + size, YEAR if size == 4 else DAY) for size in range(4, min(11, n - i + 1)) if DATE.fullmatch(value, i, i + size)]
        for j, price in ends:
            if here + price < cost[j]:
                cost[j] = here + price
                if j > reach and cost[j] < most:
                    reach = j
        for unit, times in copies:
            if times[i]:
                j = _follow(i, unit, times[i], here + sum(brute[i : i + unit]), cost, runs, most)
                if j > reach:
                    reach = j
    return cost[n]


def _follow(i: int, unit: int, times: int, base: float, cost: list[float], runs: dict, most: float) -> int:
    """Prices the ends of a repeat from place i, as far as no earlier start in the same run is cheaper; the last end priced.

    ``runs``: for unit and place in it, the end of the run and the starts followed so far with their prices.
    """
    least, end, log = 2 if unit > 1 else SHORTEST, i + unit * times, math.log10
    known = runs.get((unit, i % unit))
    if known is None or known[0] != end:
        known = runs[unit, i % unit] = end, []
    # an earlier start that is cheaper at the first end stays cheaper: the logarithms' difference only falls
    price, first = base + log(least), i // unit + least
    for s, b in known[1]:
        if b + log(first - s // unit) <= price:
            return 0
    better, reach = [(s, b) for s, b in known[1] if b <= base], 0
    for count in range(least, times + 1):
        j, price = i + unit * count, base + log(count)
        if price >= most or better and any(b + log((j - s) // unit) <= price for s, b in better):
            break
        if price < cost[j]:
            cost[j] = price
            reach = j
    known[1].append((i, base))
    return reach


@lru_cache(4096)
def _cheap(value: str, guesses: float, words: Dictionary) -> bool:
    return guess_cost(value, words, guesses) < guesses


def _values(text: str) -> list[tuple[int, int]]:
    """Values of credential contexts, by place."""
    out = [m.span(1) for m in CONTEXT.finditer(text)]
    if "://" in text and "@" in text:
        out += [m.span(1) for m in USERINFO.finditer(text)]
    return sorted(set(out))


def scan(text: str | None, guesses: float = GUESSES, words: Dictionary = BUILT_IN) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind."""
    if not text:
        return []
    out = []
    low = text.lower()
    hinted = any(h in low for h in HINTS)
    if hinted:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= VALUE_LENGTH]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if hinted or "://" in text and "@" in text:
        base, at, covered = sorted((a, b) for _, a, b in out), 0, 0
        for start, end in _values(text):
            while at < len(base) and base[at][0] <= start:
                covered, at = max(covered, base[at][1]), at + 1
            while end > start and text[end - 1] in ".)]}:!?":
                end -= 1
            if end - start >= VALUE_LENGTH and covered < end:
                value = text[start:end]
                if not (_cheap(value, guesses, words) if len(value) <= 256 else guess_cost(value, words, guesses) < guesses):
                    out.append(("guess", start, end))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words and how often they occur, summed up before they are shuffled."""
    seen: Counter[str] = Counter()

    def out() -> pd.DataFrame:
        return pd.DataFrame({"word": np.array([*seen], object), "n": np.array([*seen.values()], np.int64)})

    for rows in batches:
        release()
        for text in rows["text"]:
            if not text:
                continue
            low = _lower(text)
            if any(h in low for h in HINTS) or "://" in low and "@" in low:
                pieces, at = [], 0
                for start, end in sorted({*_values(text), *(m.span(2) for m in ASSIGN.finditer(text))}):
                    pieces.append(low[at : max(at, start)])
                    at = max(at, end)
                low = " ".join([*pieces, low[at:]])
            seen.update(w for w in _LETTERS.findall(low) if SHORTEST <= len(w) <= LONGEST)
        if len(seen) > _FLUSH:
            yield out()
            seen.clear()
    yield out()


def vocabulary_words(path: str) -> list[str]:
    """Whole words of a tokenizer's vocabulary file (JSON, words ending in ``</w>``), in its order."""
    with open(path, encoding="utf-8") as file:
        known = json.load(file)["model"]["vocab"]
    return [w[:-4] for w in sorted(known, key=known.get) if w.endswith("</w>") and w[:-4].isalpha()]


def dictionary(docs: DataFrame, vocabulary: str | None = None, size: int = DICTIONARY, text: str = "text") -> Dictionary:
    """The dictionary of a corpus: its ``size`` commonest words, merged rank by rank with those of a vocabulary file, if one is named.

    The words are placed by ranges of their counts over all
    tasks, and only the first ``size`` places come to the driver.
    """
    small_batches(docs.sparkSession)
    counted = docs.select(F.col(text).alias("text")).mapInPandas(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    first = placed(cut(counted), F.desc("n"), F.col("word")).filter(F.col("place") <= size).select("place", "word")
    own = first.toPandas().sort_values("place")["word"].tolist()
    more = vocabulary_words(vocabulary)[:size] if vocabulary else []
    both = [w for pair in zip(own, more) for w in pair] + own[len(more) :] + more[len(own) :]
    return Dictionary(both)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with every stretch of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def with_spans(docs: DataFrame, guesses: float = GUESSES, text: str = "text", words: Dictionary = BUILT_IN, name: str = "spans") -> DataFrame:
    """``docs`` with ``spans``: an array of kind, start and end. Map-only; the dictionary is broadcast."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def found(texts: pd.Series) -> pd.Series:
        release()
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in scan(t, guesses, shared.value)] for t in texts], dtype=object)

    return docs.withColumn(name, found(F.col(text)))


def redact(docs: DataFrame, guesses: float = GUESSES, words: Dictionary = BUILT_IN) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; ``n_chars``, where present, follows."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("string")
    def shown(texts: pd.Series) -> pd.Series:
        release()
        return pd.Series([t and redacted(t, scan(t, guesses, shared.value)) for t in texts], dtype=object)

    out = docs.withColumn("text", shown("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of these kinds, joined by commas."""
    some = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
