"""Rows of HTML tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from lagscope.functions.text import WHITESPACE
from lagscope.functions.times import duration_ms, parse_time

# Fields of the status page and the labels their column titles are matched against.
PAGE_LABELS = {
    "seq": "序号",
    "name": "Pipeline名字",
    "state": "mainstem状态",
    "delay": "延迟时间",
    "last_sync_time": "最后同步时间",
    "last_position_time": "最后位点时间",
}


def table_rows(css_class: str):
    """Arrow-batched reader: page text -> rows of trimmed cell texts of the tables of one class.

    Only table tags are looked at one by one; everything between them is skipped or taken as cell
    text. Rows and cells may be left unclosed.
    """
    blanks = WHITESPACE

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def rows_of_page(pages: pd.Series) -> pd.Series:
        import re
        from html import unescape

        attributes = r"""((?:"[^"]*"|'[^']*'|[^'">])*)"""
        token = re.compile(
            r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b[^>]*>(?P<code>.*?)</(?P=raw)\s*>"
            rf"|<(?P<end>/?)(?P<tag>table|tr|td|th)\b{attributes}>",
            re.I | re.S,
        )
        any_tag = re.compile(rf"</?[a-zA-Z]{attributes}>|<![^>]*>")
        class_of = re.compile(r"""(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

        def parse(text):
            if text is None:
                return None
            rows, tables, at = [], [], 0  # a table: [wanted, open row, open cell]
            for match in token.finditer(text):
                cells = [t[2] for t in tables if t[2] is not None]
                if cells:
                    piece = unescape(any_tag.sub("", text[at : match.start()])) + (match["code"] or "")
                    for cell in cells:
                        cell.append(piece)
                at = match.end()
                tag = match["tag"] and match["tag"].lower()
                if tag == "table" and not match["end"]:
                    found = class_of.search(match[match.lastindex] or "")
                    classes = next((g for g in found.groups() if g is not None), "") if found else ""
                    wanted = bool(tables and tables[-1][0]) or css_class in unescape(classes).split()
                    tables.append([wanted, None, None])
                elif tag == "table" and tables:
                    tables.pop()
                elif tag == "tr" and tables:
                    tables[-1][1:] = [None, None] if match["end"] or not tables[-1][0] else [[], None]
                    if tables[-1][1] is not None:
                        rows.append(tables[-1][1])
                elif tag and tables and tables[-1][1] is not None:
                    tables[-1][2] = None if match["end"] else []
                    if not match["end"]:
                        tables[-1][1].append(tables[-1][2])
            return [["".join(cell).strip(blanks) for cell in row] for row in rows]

        return pages.map(parse)

    # Keeps Spark from running the reader once more for the filter it derives from the explode.
    return rows_of_page.asNondeterministic()


def bind_columns(titles: Column, labels: dict[str, str]) -> dict[str, Column]:
    """Index of the title each label binds to, or NULL.

    A label takes the first title that is part of it (an empty title is part of any label). If two
    labels take the same title, the later one has it and the earlier one stays unbound.
    """

    def first_title(label: str) -> Column:
        at = F.sequence(F.lit(0), F.size(titles) - 1)
        return F.get(F.filter(at, lambda i: F.lit(label).contains(F.get(titles, i))), F.lit(0))

    first = {name: first_title(label) for name, label in labels.items()}
    names = list(labels)
    bound = {}
    for at, name in enumerate(names):
        taken = F.lit(False)
        for later in names[at + 1 :]:
            taken = taken | F.coalesce(first[later] == first[name], F.lit(False))
        bound[name] = F.when(~taken, first[name])
    return bound


def extract_html_table(df: DataFrame, html_col: str, css_class: str = "list",
                       labels: dict[str, str] | None = None) -> DataFrame:
    """One record per data row of each page's table, with the page's other columns kept.

    The first row of a page holds its titles. Columns no title binds to, and cells a short row
    lacks, are empty text. Parsing is the only Python step; pages are spread as Spark reads them.
    """
    labels = labels or PAGE_LABELS
    keep = [c for c in df.columns if c != html_col]
    parsed = df.withColumn("_rows", table_rows(css_class)(F.col(html_col))).filter(F.size("_rows") > 1)
    titles = F.get("_rows", F.lit(0))
    at = F.when(F.size(titles) > 0, F.struct(*[c.alias(n) for n, c in bind_columns(titles, labels).items()]))
    bound = parsed.select(*keep, at.alias("_at"), F.slice("_rows", F.lit(2), F.size("_rows") - 1).alias("_data"))
    rows = bound.select(*keep, "_at", F.posexplode("_data").alias("row", "_cells"))
    return rows.select(
        *keep,
        (F.col("row") + 1).alias("row"),
        *[F.coalesce(F.get("_cells", F.col(f"_at.{n}")), F.lit("")).alias(n) for n in labels],
    )


def page_points(rows: DataFrame, time: Column) -> DataFrame:
    """Status page rows as point columns: id, state, delay in whole ms, and the two times."""
    return rows.select(
        time.alias("time"),
        F.col("seq").alias("pipeline_id"),
        "state",
        duration_ms("delay").cast("double").alias("delay_time"),
        parse_time("last_sync_time").alias("last_sync_time"),
        parse_time("last_position_time").alias("last_position_time"),
    )
