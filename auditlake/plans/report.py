"""Reports and dashboards as Markdown, HTML and DOCX, from ordered rows."""

from __future__ import annotations

import html
import json
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import score, text
from auditlake.operators import acquisition
from auditlake.operators.common import placed, zero_filled

SECTIONS = {
    "en": ("Regulatory event report", "Key actions", "Events", "Watch list", "Deduplication", "Coverage", "Gaps"),
    "zh": ("监管事件报告", "重点行动", "事件", "观察清单", "去重", "覆盖", "缺口"),
}


def ordered(events: DataFrame) -> DataFrame:
    """Events with ``place``: level, then score, then effective date (none last), then position."""
    return placed(events, F.desc(score.level_rank(F.col("level"))), F.desc("score"), F.coalesce("effective_date", F.lit("9999-99-99")), F.col("pos"))


def sections(events: DataFrame) -> DataFrame:
    """Events with where a report tells them: ``watch`` (unconfirmed) or main list, and ``key_action`` of high and medium ones."""
    watch = F.col("status") == "unconfirmed"
    return events.withColumn("watch", watch).withColumn("key_action", ~watch & F.col("level").isin("high", "medium"))


DISPOSITIONS = ("duplicate_removed", "material_update", "operational_refresh", "review_required")


def disposition_counts(matches: DataFrame) -> DataFrame:
    """How many matches came to each of the four dispositions."""
    return zero_filled(matches.groupBy("disposition").agg(F.count("*").alias("n")), "disposition", DISPOSITIONS)


def event_block(place: str = "place") -> Column:
    """An event as Markdown."""
    line = lambda label, c: F.concat(F.lit(f"- **{label}**: "), text.table_cell(F.col(c)), F.lit("\n"))
    head = F.concat(F.lit("### "), F.col(place).cast("string"), F.lit(". "), text.table_cell(F.col("title")), F.lit("\n\n"))
    return F.concat(head, line("Level", "level"), line("Status", "status"), line("Authority", "authority"), line("Jurisdiction", "jurisdiction"), line("Summary", "summary"), line("Impact", "impact"), line("Action", "action"), F.lit("- **Source**: ["), text.table_cell(F.col("source_title")), F.lit("]("), F.col("source_url"), F.lit(")\n"))


def markdown(events: DataFrame, matches: DataFrame | None = None, ledger: DataFrame | None = None, gaps: tuple[str, ...] = (), language: str = "en", date: str = "") -> str:
    """A report's text. Blocks are made by the executors; the driver joins them in order."""
    title, actions, main, watch, dedup, coverage, missing = SECTIONS["zh" if language.lower().startswith("zh") else "en"]
    rows = sections(ordered(events)).select("place", "watch", "key_action", "title", "action", event_block().alias("block")).orderBy("place")
    out = {main: [], watch: [], actions: []}
    for r in rows.toLocalIterator():
        out[watch if r["watch"] else main].append(r["block"])
        if r["key_action"]:
            out[actions].append(f"- {r['title']}: {r['action']}")
    parts = [f"# {title} {date}".rstrip(), f"## {actions}", "\n".join(out[actions]) or "-", f"## {main}", "\n".join(out[main]) or "-", f"## {watch}", "\n".join(out[watch]) or "-"]
    if matches is not None:
        n = {r["disposition"]: r["n"] for r in disposition_counts(matches).collect()}
        parts += [f"## {dedup}", "\n".join(f"- {k}: {n[k]}" for k in DISPOSITIONS)]
    if ledger is not None:
        lines = ["| Platform | Market | Program | Access | Checked |", "| --- | --- | --- | --- | --- |"]
        cells = ("platform", "seller_market", "program", "access_result", "checked_at")
        lines += ["| " + " | ".join(r) + " |" for r in ledger.select(*[text.table_cell(F.col(c)).alias(c) for c in cells]).toLocalIterator()]
        parts += [f"## {coverage}", "\n".join(lines)]
    parts += [f"## {missing}", "\n".join(f"- {g}" for g in gaps) or "-"]
    return "\n\n".join(parts) + "\n"


def dashboard_rows(dashboard: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in dashboard.toLocalIterator()]


def dashboard_markdown(dashboard: DataFrame) -> str:
    lines = ["# Source coverage", "", "| Platform | Depth | Priority | Actions |", "| --- | --- | --- | --- |"]
    return "\n".join([*lines, *(f"| {r['platform']} | {r['depth']} | {r['priority']} | {'; '.join(r['actions'])} |" for r in dashboard_rows(dashboard))]) + "\n"


def dashboard_json(dashboard: DataFrame) -> str:
    totals = acquisition.dashboard_summary(dashboard).first().asDict()
    return json.dumps({"summary": totals, "platforms": dashboard_rows(dashboard)}, ensure_ascii=False, indent=2, default=str) + "\n"


def dashboard_html(dashboard: DataFrame) -> str:
    cells = lambda r: "".join(f"<td>{html.escape(str(x))}</td>" for x in (r["platform"], r["depth"], r["priority"], "; ".join(r["actions"])))
    body = "".join(f"<tr>{cells(r)}</tr>" for r in dashboard_rows(dashboard))
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Source coverage</title></head><body><h1>Source coverage</h1><table><tr><th>Platform</th><th>Depth</th><th>Priority</th><th>Actions</th></tr>{body}</table></body></html>'


def docx(markdown_text: str, path: str) -> None:
    """A report's text as a plain DOCX file, without a template."""
    kinds = ("[Content_Types].xml", "_rels/.rels", "word/document.xml")
    para = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line.lstrip("#").strip())}</w:t></w:r></w:p>' for line in markdown_text.split("\n") if line.strip())
    parts = (
        '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{para}</w:body></w:document>',
    )
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in zip(kinds, parts):
            z.writestr(name, content)
