"""Tables as HTML and GitHub Markdown, as column expressions over array<array<string>> rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import gfm_escape, html_escape


def table_html(rows: Column) -> Column:
    cells = lambda r: F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), html_escape(c), F.lit("</td>"))), "")
    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr>"), cells(r), F.lit("</tr>"))), ""), F.lit("</table>"))


def table_markdown(rows: Column) -> Column:
    """The first row is the header."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, gfm_escape), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.get(rows, F.lit(0)))))
    every = F.concat(F.array(line(F.get(rows, F.lit(0))), rule), F.transform(F.slice(rows, 2, F.size(rows)), line))
    return F.array_join(every, "\n")
