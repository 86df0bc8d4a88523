"""Expressions on tables held as arrays of rows of cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _blank(cell: Column) -> Column:
    return F.trim(F.coalesce(cell, F.lit(""))) == ""


def drop_empty_rows(rows: Column | str) -> Column:
    """Rows with a cell that is not blank; null rows go."""
    return F.filter(_col(rows), lambda r: F.coalesce(F.exists(r, lambda c: ~_blank(c)), F.lit(False)))


def width(rows: Column | str) -> Column:
    return F.coalesce(F.array_max(F.transform(_col(rows), lambda r: F.coalesce(F.size(r), F.lit(0)))), F.lit(0))


def pad_rows(rows: Column | str) -> Column:
    """All rows as wide as the widest, filled with empty cells on the right; null cells become empty."""
    r, w = _col(rows), width(rows)
    fill = lambda x: F.concat(F.transform(x, lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), F.greatest(F.lit(0), w - F.size(x))))
    return F.transform(r, lambda x: fill(F.coalesce(x, F.array().cast("array<string>"))))


def fill_down(rows: Column | str) -> Column:
    """Blank cells take the last cell above them that is not, below the header row."""
    def step(done: Column, row: Column) -> Column:
        above = F.element_at(done, -1)
        own = F.when(F.size(done) <= 1, row).otherwise(F.transform(row, lambda c, i: F.when(_blank(c) & ~_blank(F.get(above, i)), F.get(above, i)).otherwise(c)))
        return F.concat(done, F.array(own))

    return F.aggregate(_col(rows), F.array().cast("array<array<string>>"), step)


def to_markdown(rows: Column | str) -> Column:
    """Header, separator and rows as a pipe table; empty for no rows."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    r = _col(rows)
    head = F.element_at(r, 1)
    bar = F.concat(F.lit("| "), F.array_join(F.transform(head, lambda c: F.lit("---")), " | "), F.lit(" |"))
    all_rows = F.concat(F.array(line(head), bar), F.transform(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), line))
    return F.when(F.size(r) > 0, F.array_join(all_rows, "\n")).otherwise(F.lit(""))


def placeholder(n_rows: Column | str, n_columns: Column | str) -> Column:
    """A grid of empty cells."""
    return F.array_repeat(F.array_repeat(F.lit(""), _col(n_columns)), _col(n_rows))


def markdown_to_html(markdown: Column | str) -> Column:
    """A pipe table as an HTML table; what is none (under three lines, or a line without a pipe) becomes a paragraph."""
    lines = F.filter(F.split(_col(markdown), "\n"), lambda x: F.trim(x) != "")
    cells = lambda x, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.concat(F.lit(f"<{tag}>"), F.trim(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), lambda x: cells(x, "td")), "")
    table = F.concat(F.lit("<table><thead>"), cells(F.element_at(lines, 1), "th"), F.lit("</thead><tbody>"), body, F.lit("</tbody></table>"))
    whole = (F.size(lines) >= 3) & F.forall(lines, lambda x: F.contains(x, F.lit("|")))
    return F.when(whole, table).otherwise(F.concat(F.lit("<p>"), _col(markdown), F.lit("</p>")))
