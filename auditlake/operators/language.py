"""Whether texts are in the language that a report declares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text


def mismatch(family: Column, han: Column, latin: Column) -> Column:
    """zh: 75 % Latin and fewer than 8 Han letters; en: 35 % Han and 8 of them; only from 20 letters on."""
    letters = han + latin
    zh = (family == "zh") & (latin >= 0.75 * letters) & (han < 8)
    en = (family == "en") & (han >= 0.35 * letters) & (han >= 8)
    return (letters >= 20) & (zh | en)


def assess(events: DataFrame, body: str = "text", declared: str = "language") -> DataFrame:
    """Events with family, han, latin and mismatch."""
    out = events.withColumn("family", text.family(F.col(declared))).withColumn("han", text.han_letters(F.col(body))).withColumn("latin", text.latin_letters(F.col(body)))
    return out.withColumn("mismatch", mismatch(F.col("family"), F.col("han"), F.col("latin")))


def event_text(columns: list[str]) -> Column:
    """All text of an event, with its products and action items where it has them."""
    parts = [text.text_of(F.col(c)) for c in ("title", "summary", "impact", "action", "rationale") if c in columns]
    if "products" in columns:
        parts.append(F.array_join("products", " "))
    if "action_items" in columns:
        parts.append(F.array_join(F.transform("action_items", lambda a: F.concat_ws(" ", a["owner"], a["action"], a["deadline"], a["completion_evidence"])), " "))
    return F.concat_ws(" ", *parts)
