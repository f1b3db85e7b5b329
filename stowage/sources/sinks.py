"""Exports: single CSV files of bounded reports, and the tree page as one HTML file."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..operators import archives as A
from ..operators import kinds as K
from ..operators import reports as R


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header in a folder; quotes are doubled, so commas, quotes and line ends come back as they were."""
    df.coalesce(1).write.mode("overwrite").options(header=True, quote='"', escape='"', escapeQuotes=True).csv(path)


def write_csv_parts(df: DataFrame, path: str) -> None:
    """As :func:`write_csv`, but a file for each partition, for results without a bound."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def export_listing(files: DataFrame, out: str) -> None:
    """top_dirs, duplicates, by_year, by_extension and hotspots of a listing."""
    files = files.select("folder", "name", "ext", "size", "content_hash", "modified")
    write_csv(R.top_folders(files, 5000), f"{out}/top_dirs")
    write_csv(R.duplicates_top(files, 5000), f"{out}/duplicates")
    write_csv(R.cold_by_year(files).orderBy("year"), f"{out}/by_year")
    write_csv(R.extension_profile(files, 1000), f"{out}/by_extension")
    write_csv(R.hotspots(files, limit=1000), f"{out}/hotspots")


def export_kinds(cube: DataFrame, out: str) -> None:
    """kinds, kinds_by_month, kinds_older_than and kinds_listing of a tally, in whole bytes (halves to even)."""
    whole = lambda c: F.bround(c).cast("long").alias(c)
    write_csv(K.kinds_table(cube).select("kind", whole("loose"), whole("tarred")).orderBy("kind"), f"{out}/kinds")
    write_csv(K.kinds_by_month(cube).select("kind", "month", whole("size")).orderBy("kind", "month"), f"{out}/kinds_by_month")
    write_csv(K.kinds_older(cube).select("kind", "years", whole("loose"), whole("tarred")).orderBy("kind", "years"), f"{out}/kinds_older_than")
    write_csv(K.kinds_totals(cube).select(*map(whole, ("total", "members", "by_name", "undated"))), f"{out}/kinds_listing")


def export_archive(members: DataFrame, archive_id: int, out: str) -> None:
    """manifest and by_dir (in parts, as there may be very many members and folders) and by_extension of one archive."""
    own = members.filter(F.col("archive_id") == archive_id)
    write_csv_parts(A.manifest(own), f"{out}/manifest")
    sums = A.summary(own)
    write_csv_parts(sums.filter(F.startswith("section", F.lit("dir"))).orderBy("section", F.desc("bytes"), "key"), f"{out}/by_dir")
    write_csv(sums.filter("section = 'ext'").orderBy(F.desc("bytes"), "key"), f"{out}/by_extension")


PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif}}details{{margin-left:1.2em}}.b{{display:inline-block;width:8em;background:#eee}}.b i{{display:block;height:.7em;background:#69c}}td,th{{padding:0 .6em;text-align:left}}.k{{background:#dfe8d6;border-radius:.6em;padding:0 .5em}}</style></head>
<body><h1>{title}</h1><p>Entries of at least {threshold}.</p>
{facts}
{tree}
{tables}
</body></html>
"""


def render_page(out: str, title: str, threshold: int, rows: Iterable, tables: dict[str, list], badges: dict[str, str] | None = None, facts: Iterable[str] = ()) -> None:
    """Write the tree page whole or not at all: rows of ``figures.layout`` (bounded by its max_rows), and the chosen tables.

    ``badges``: a word on some folders, by path; ``facts``: sentences about the page as a whole.
    """
    badges = badges or {}
    inside: dict = {}
    for r in rows:
        inside.setdefault(r["parent"], []).append(r)
    parts: list[str] = []
    # an explicit stack: trees may be deep
    todo: list = [(r, r["size"]) for r in inside.get(None, [])]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            parts.append(item)
            continue
        r, above = item
        label = values.escaped(r["name"].rsplit("/", 1)[-1] or r["name"]) if r["kind"] != "fold" else f"{values.plural(r['entries'], 'smaller entry').replace('entrys', 'entries')}"
        share = r["size"] / above if above else 0
        line = f'<span class="b"><i style="{values.bar(share)}"></i></span> {values.human_bytes(r["size"])} {label}'
        if r["kind"] == "dir":
            badge = f' <span class="k">{values.escaped(badges[r["name"]])}</span>' if r["name"] in badges else ""
            parts.append(f"<details{' open' if r['parent'] is None else ''}><summary>{line} ({values.plural(r['files'], 'file')}){badge}</summary>")
            todo.append("</details>")
            below = sorted(inside.get(r["name"], []), key=lambda x: (x["kind"] == "fold", -x["size"], x["name"]))
            todo += [(x, r["size"]) for x in reversed(below)]
        else:
            parts.append(f"<div>{line}</div>")
    shown = "".join(
        f"<h2>{values.escaped(name)}</h2><table>" + "".join("<tr>" + "".join(f"<td>{values.escaped(v)}</td>" for v in row) + "</tr>" for row in chosen) + "</table>" for name, chosen in tables.items()
    )
    text = PAGE.format(title=values.escaped(title), threshold=values.human_bytes(threshold), tree="\n".join(parts), tables=shown, facts="\n".join(f"<p>{values.escaped(f)}</p>" for f in facts))
    handle, path = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(out)), suffix=".part")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(path, out)
    except BaseException:
        os.unlink(path)
        raise
