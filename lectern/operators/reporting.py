"""Reports: Markdown to HTML, pages of published records, worksheets of blinded word checks."""

from __future__ import annotations

import html
import re
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _inline(s: str) -> str:
    s = html.escape(s, quote=False)
    s = re.sub(r"`([^`]+)`", r"<code>\1</code>", s)
    s = re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", s)
    s = re.sub(r"\*([^*]+)\*", r"<em>\1</em>", s)
    return re.sub(r"\[([^\]]+)\]\((https?://[^)\s]+)\)", r'<a href="\2">\1</a>', s)


def markdown(source: str) -> str:
    """Headings, lists, pipe tables, fenced code, quotes, links and emphasis as HTML."""
    out: list[str] = []
    kind, block = "", []

    def close() -> None:
        nonlocal kind, block
        if kind == "p":
            out.append(f"<p>{_inline(' '.join(block))}</p>")
        elif kind == "quote":
            out.append(f"<blockquote>{_inline(' '.join(block))}</blockquote>")
        elif kind in ("ul", "ol"):
            out.append(f"<{kind}>" + "".join(f"<li>{_inline(x)}</li>" for x in block) + f"</{kind}>")
        elif kind == "code":
            out.append("<pre><code>" + html.escape("\n".join(block)) + "</code></pre>")
        elif kind == "table":
            rows = [[c.strip() for c in r.strip().strip("|").split("|")] for r in block]
            head = len(rows) > 1 and all(re.fullmatch(r":?-+:?", c) for c in rows[1])
            cell = lambda tag, r: "<tr>" + "".join(f"<{tag}>{_inline(c)}</{tag}>" for c in r) + "</tr>"
            out.append("<table>" + "".join(cell("th" if head and k == 0 else "td", r) for k, r in enumerate(rows) if not (head and k == 1)) + "</table>")
        kind, block = "", []

    def add(k: str, x: str) -> None:
        nonlocal kind
        if kind != k:
            close()
            kind = k
        block.append(x)

    for line in source.split("\n"):
        if kind == "code":
            if line.startswith("```"):
                close()
            else:
                block.append(line)
        elif line.startswith("```"):
            close()
            kind = "code"
        elif m := re.match(r"(#{1,6}) (.*)", line):
            close()
            out.append(f"<h{len(m[1])}>{_inline(m[2])}</h{len(m[1])}>")
        elif m := re.match(r"[-*] (.*)", line):
            add("ul", m[1])
        elif m := re.match(r"\d+\. (.*)", line):
            add("ol", m[1])
        elif line.startswith(">"):
            add("quote", line[1:].strip())
        elif line.startswith("|"):
            add("table", line)
        elif line.strip():
            add("p", line.strip())
        else:
            close()
    close()
    return "\n".join(out)


def index_rows(ledger: DataFrame) -> DataFrame:
    """Published rows, latest identification first, then in ledger order."""
    from .ledger import publishable

    return ledger.where(publishable(F.col("status"), F.col("confidence"), F.col("known_from"))).orderBy(F.desc("identified_on"), "order")


def page(row: dict, report: str) -> str:
    """The page of one published record."""
    title = html.escape(f"{row['institution'] or ''}, {row['shelfmark'] or ''}")
    return f"<!doctype html><title>{title}</title><h1>{title}</h1><p>{html.escape(row['identification'] or '')}</p>{markdown(report)}"


def site(ledger: DataFrame, reports: dict[str, str]) -> dict[str, str]:
    """Names and contents of all pages: an index and a page for each published record. The published ledger is small by nature."""
    rows = [r.asDict() for r in index_rows(ledger).collect()]
    links = "".join(f'<li><a href="{html.escape(r["id"])}.html">{html.escape(r["identification"] or r["id"])}</a></li>' for r in rows)
    return {"index.html": f"<!doctype html><title>Index</title><ul>{links}</ul>"} | {f"{r['id']}.html": page(r, reports.get(r["id"], "")) for r in rows}


def burndown(worklist: DataFrame, most: int | None = None) -> str:
    """The page of what is left: a table of rows (id, state, priority), the highest priority first, ties by id."""
    rows = worklist.orderBy(F.desc("priority"), "id")
    rows = (rows.limit(most) if most else rows).collect()
    lines = "".join(f"<tr><td>{html.escape(r['id'])}</td><td>{html.escape(r['state'])}</td><td>{r['priority']}</td></tr>" for r in rows)
    return f"<!doctype html><title>What is left</title><table>{lines}</table>"


def publish(pages: dict[str, str], folder: str) -> list[str]:
    """Writes pages to a folder of the driver and deletes pages there that are no longer made; the names of these are returned."""
    where = Path(folder)
    where.mkdir(parents=True, exist_ok=True)
    for name, content in pages.items():
        (where / name).write_text(content, encoding="utf-8")
    stale = sorted(p.name for p in where.glob("*.html") if p.name not in pages)
    for name in stale:
        (where / name).unlink()
    return stale


def sections(sheets: DataFrame) -> DataFrame:
    """(set, file, reader, words, status): answer sheets (set, reader, text) split at === file === lines; repeated and unread headers are told."""
    parts = F.regexp_extract_all("text", F.lit(r"(?s)===\s*(\S+)\s*===\s*\n(.*?)(?=\n===|$)"), F.lit(0))
    rows = sheets.select("set", "reader", F.explode(parts).alias("part"))
    out = rows.select("set", "reader", F.regexp_extract("part", r"===\s*(\S+)\s*===", 1).alias("file"), F.trim(F.regexp_replace(F.regexp_replace("part", r"^===\s*\S+\s*===", ""), r"\s+", " ")).alias("words"))
    n = F.count("*").over(Window.partitionBy("set", "reader", "file"))
    return out.withColumn("status", F.when(n > 1, "duplicate header").otherwise("ok"))


def paired(key: DataFrame, answers: DataFrame) -> DataFrame:
    """The key (set, file, original) with every reader's answer, those without one kept."""
    own = answers.groupBy("set", "file").agg(F.array_sort(F.collect_list(F.struct("reader", "words"))).alias("answers"))
    return key.join(own, ["set", "file"], "left").orderBy("set", "file")


def blinded(rows: DataFrame, seed: int = 0) -> DataFrame:
    """An order inside each set that depends on seed and file alone."""
    w = Window.partitionBy("set").orderBy(F.xxhash64(F.lit(seed), "set", "file"), "file")
    return rows.withColumn("place", F.row_number().over(w))
