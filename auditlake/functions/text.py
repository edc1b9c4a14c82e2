"""Text, URL and scope columns, from built-in functions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake import constants as K

#: A word: letters, digits and underscores of any script, without combining marks.
WORD = r"[\p{L}\p{N}_]+"
SPACES = r"[\s\p{Z}\x1C-\x1F]+"


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def tokens(c: Column) -> Column:
    """Lower-cased words."""
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit(WORD), F.lit(0))


def normalized(c: Column, separator: str = " ") -> Column:
    """Lower-cased words joined by a separator; ``functions.udfs.casefold`` first gives full case folding."""
    return F.array_join(tokens(c), separator)


def compact(c: Column) -> Column:
    return normalized(c, "")


def normalized_set(items: Column) -> Column:
    """Distinct non-empty normalised items, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: normalized(x)), lambda x: x != "")))


def nonblank(c: Column) -> Column:
    return F.length(F.regexp_replace(text_of(c), SPACES, "")) > 0


def stripped(c: Column) -> Column:
    return F.regexp_replace(text_of(c), rf"^{SPACES}|{SPACES}$", "")


def spaced(c: Column) -> Column:
    """Lower case, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text_of(c)), SPACES, " "))


def distinct_strings(items: Column) -> Column:
    """Trimmed non-blank strings, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(items, stripped), lambda x: x != ""))


def _lookup(aliases: Mapping[str, str], c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)


def canonical_scope(c: Column) -> Column:
    return _lookup(K.SCOPE_ALIASES, normalized(c))


def known_scope(c: Column) -> Column:
    """The canonical scope; null if it says nothing. ``N/A`` normalises to ``n a`` and so counts as known."""
    scope = canonical_scope(c)
    return F.when(~scope.isin(*K.UNKNOWN_SCOPES), scope)


def catalog_scope(c: Column) -> Column:
    return _lookup(K.CATALOG_ALIASES, spaced(c))


def same_scope(a: Column, b: Column) -> Column:
    return catalog_scope(a) == catalog_scope(b)


def conflicts(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Whether any pair of scopes is known on both sides and differs."""
    out = F.lit(False)
    for a, b in pairs:
        out = out | F.coalesce(known_scope(a) != known_scope(b), F.lit(False))
    return out


def _query(url: Column, dropped: Sequence[str]) -> Column:
    asked = F.regexp_extract(url, r"\?([^#]*)", 1)

    def keep(pair: Column) -> Column:
        key = F.lower(F.regexp_extract(pair, "^[^=]*", 0))
        return (pair != "") & ~key.startswith("utm_") & ~key.isin(*dropped)

    with_equals = F.transform(F.split(asked, "&"), lambda p: F.when((p == "") | p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    return F.array_join(F.array_sort(F.filter(with_equals, keep)), "&")


def is_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^https?://[^/?#\s]+"), F.lit(False))


def canonical_url(c: Column, strip_slash: bool = True) -> Column:
    """Scheme and host in lower case, tracking parameters and fragment dropped, parameters sorted.

    Percent-encoding stays as it is; ``functions.udfs.canonical_url`` re-encodes. What is no URL is normalised text.
    """
    url = stripped(c)
    head = F.lower(F.regexp_extract(url, r"^(?i)https?://[^/?#]+", 0))
    path = F.regexp_extract(url, r"^(?i)https?://[^/?#]+([^?#]*)", 1)
    if strip_slash:
        path = F.regexp_replace(path, "/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    asked = _query(url, K.TRACKING_KEYS)
    out = F.concat(head, path, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(F.lit("")))
    return F.when(is_url(F.lower(url)), out).otherwise(normalized(url))


def authority(c: Column) -> Column:
    """Host with port and user, in lower case."""
    return F.lower(F.regexp_extract(text_of(c), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def identifiers(text: Column) -> Column:
    """Distinct normalised regulatory identifiers."""
    found = F.regexp_extract_all(F.lower(text_of(text)), F.lit(K.IDENTIFIERS), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: normalized(x))))


def facts(text: Column) -> Column:
    """Sorted dates, numbers and amounts, with repeats, without blanks."""
    found = F.regexp_extract_all(F.lower(text_of(text)), F.lit(K.FACTS), F.lit(0))
    return F.array_sort(F.transform(found, lambda x: F.replace(x, F.lit(" "), F.lit(""))))


def obligations(text: Column) -> Column:
    # the text is the outer function's item, so that it is lowered once, not for each term
    terms = F.array(*[F.lit(t) for t in sorted(K.OBLIGATIONS)])
    return F.transform(F.array(F.lower(text_of(text))), lambda low: F.filter(terms, lambda t: F.contains(low, t)))[0]


def number_anchors(title: Column) -> Column:
    """Distinct whole numbers but years, without ordinal endings or leading zeros, sorted as text."""
    found = F.regexp_extract_all(text_of(title), F.lit(r"(?<![0-9])[0-9]+"), F.lit(0))
    plain = F.transform(found, lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
    return F.array_sort(F.array_distinct(F.filter(plain, lambda x: ~x.rlike("^(19[0-9][0-9]|20[0-9][0-9]|2100)$"))))


def hs_code(c: Column) -> Column:
    return F.regexp_replace(text_of(c), r"[.\s-]", "")


def valid_hs(code: Column) -> Column:
    return code.rlike("^[0-9]{4,10}$")


def hs_codes(declared: Column, text: Column) -> Column:
    """Valid codes that are declared or named in the text."""
    named = F.regexp_extract_all(text_of(text), F.lit(r"(?i)\bHS(?:\s+code)?\s*[:：]?\s*([0-9][0-9.\s-]{2,12}[0-9])"), F.lit(1))
    both = F.concat(F.coalesce(declared, F.array().cast("array<string>")), named)
    return F.array_sort(F.array_distinct(F.filter(F.transform(both, hs_code), valid_hs)))


def hs_overlap(a: Column, b: Column) -> Column:
    return a.startswith(b) | b.startswith(a)


def han_letters(c: Column) -> Column:
    return F.regexp_count(text_of(c), F.lit("[\\u3400-\\u4dbf\\u4e00-\\u9fff]"))


def latin_letters(c: Column) -> Column:
    return F.regexp_count(text_of(c), F.lit("[A-Za-z]"))


def family(c: Column) -> Column:
    low = F.lower(stripped(c))
    return F.when(low.startswith("zh"), "zh").when(low.startswith("en"), "en").otherwise("unknown")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def run_name(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.*)\.labels\.json$", 1)


def table_cell(c: Column) -> Column:
    """Text for a cell of a Markdown table."""
    return F.regexp_replace(F.replace(text_of(c), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")


def content_lines(c: Column, inner: bool = True) -> Column:
    """Non-blank trimmed lines; ``inner``: white space runs inside become one space. Take the NFKC form first."""
    lines = F.transform(F.split(F.replace(text_of(c), F.lit(" "), F.lit(" ")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), stripped)
    if inner:
        lines = F.transform(lines, lambda x: F.regexp_replace(x, SPACES, " "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def like_any(columns: Sequence[Column], query: str) -> Column:
    """ASCII-case-insensitive containment; ``%`` and ``_`` in the query are wildcards."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = "%" + query.translate(str.maketrans(upper, lower)) + "%"
    out = F.lit(False)
    for c in columns:
        out = out | F.translate(text_of(c), upper, lower).like(pattern)
    return out


def prefix_match(text: Column, query: str) -> Column:
    """Whether a word of the text begins with a word of the query."""
    asked = re.findall(r"\w+", query.lower())
    words = tokens(text)
    return F.exists(words, lambda w: reduce(lambda a, q: a | w.startswith(q), asked, F.lit(False)))


def named_in(scope: Column, alias: Column) -> Column:
    """ASCII aliases as whole words, others anywhere, in lower case."""
    low, name = F.lower(text_of(scope)), F.lower(alias)
    whole = F.concat(F.lit("(?<![a-z0-9])\\Q"), name, F.lit("\\E(?![a-z0-9])"))
    return F.when(name.rlike("^[\\x00-\\x7F]+$"), F.regexp_like(low, whole)).otherwise(F.contains(low, name))
