"""Content-derived ids and signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions import text


def hashed(c: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, length)


def lead_id(url: Column, claim: Column, published_at: Column) -> Column:
    return hashed(F.concat_ws("\n", text.canonical_url(url), F.lower(text.stripped(claim)), text.text_of(published_at)), 24)


def cluster_id(lead_ids: Column) -> Column:
    return hashed(F.array_join(F.array_sort(lead_ids), "\n"), 24)


def task_id(*fields: Column) -> Column:
    return hashed(F.concat_ws("\n", *[text.text_of(f) for f in fields]), 24)


def page_key(url: Column) -> Column:
    return hashed(url, 20)


def snapshot_id(captured: Column, content_hash: Column) -> Column:
    return F.concat(F.date_format(captured, "yyyyMMddHHmmss"), F.lit("-"), F.substring(content_hash, 1, 12))


def source_id(*values: Column) -> Column:
    return hashed(F.lower(F.concat_ws("\n", *[text.text_of(v) for v in values])), 24)


def object_json(fields: dict[str, Column]) -> Column:
    """Canonical JSON of an object: keys sorted, no blanks, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def signature(fields: dict[str, Column]) -> Column:
    """The alert signature; ``fields`` gives the columns of ``SIGNATURE_FIELDS``."""
    return hashed(object_json({k: fields[k] for k in K.SIGNATURE_FIELDS}))


def report_key(report_date: Column, cutoff: Column, scope: Column) -> Column:
    return hashed(object_json({"report_date": report_date, "cutoff": cutoff, "scope": scope}), 24)


def fingerprint(fields: dict[str, Column]) -> Column:
    """Of a review: normalised identity fields."""
    return hashed(object_json({k: text.normalized(v) for k, v in fields.items()}))
