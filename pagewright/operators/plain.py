"""Tables without rules of plain pages, a batch of pages at a time.

A page is plain where no span has to look further back than to the one before it: rows are apart by more than the
tolerance or on one baseline, none is raised, each cell of a table is one span, and on a page with tables no line stands
beside them. There ``page.structure`` gives what is told here by comparing neighbours in arrays; all other pages go through it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

from ..functions.scripts import RIGHT_TO_LEFT

#: Times that runs of rows are cut at their first misfit; a page with more cuts is not plain.
MOST_CUTS = 8
#: Texts between which a line has a space, and that are written the same in HTML and Markdown.
SIMPLE_TEXT = r"\A[0-9A-Za-z](?:[0-9A-Za-z .,:;]*[0-9A-Za-z])?\z"
WEIGHTED = re.compile("courier|mono|typewriter|cmtt|bold|demi|medi", re.I)


@dataclass
class Found:
    """The plain pages of a batch and their cells (a span each), in order of page, table, row and column."""

    plain: np.ndarray
    span: np.ndarray
    page: np.ndarray
    table: np.ndarray
    row: np.ndarray
    column: np.ndarray
    #: Where each cell's table begins, and its number of columns.
    begins: np.ndarray
    columns: np.ndarray
    box: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    seq: np.ndarray
    size: np.ndarray
    #: x, y and height of each cell's line.
    line: tuple[np.ndarray, np.ndarray, np.ndarray]


def _floats(values) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(float)


def _right_to_left(page: np.ndarray, texts, bad) -> None:
    """Pages with right-to-left letters are not plain."""
    letters = texts.buffers()[2]
    if letters is not None and (np.frombuffer(letters, np.uint8) >= 128).any():
        bad(np.array([RIGHT_TO_LEFT.search(t or "") is not None for t in texts.to_pylist()], bool), page)


def tables_of(flat, ends: np.ndarray, drawn: np.ndarray, o) -> Found:
    """Spans ``flat`` (a struct array), those of page k from ``ends[k]`` to ``ends[k + 1]``; ``drawn``: pages that are turned or
    have fills or paths, which are not plain."""
    import pyarrow.compute as pc

    pages, n, tolerance = len(ends) - 1, len(flat), o.line_tolerance
    broken = drawn.copy()

    def bad(where: np.ndarray, of: np.ndarray) -> None:
        broken[of[where]] = True

    page = np.repeat(np.arange(pages), np.diff(ends))
    x, y, w, h, size = (_floats(flat.field(c)) for c in ("x", "y", "width", "height", "font_size"))
    w, h = np.nan_to_num(w), np.nan_to_num(h)
    size = np.where(np.nan_to_num(size) == 0, h, size)
    bad(~(np.isfinite(x) & np.isfinite(y) & np.isfinite(w) & np.isfinite(h)), page)
    for c in ("x", "y", "width", "height", "font_size"):  # what is no number is looked at one by one
        bad(pc.fill_null(pc.is_nan(flat.field(c)), False).to_numpy(zero_copy_only=False), page)
    bad(pc.fill_null(pc.equal(flat.field("direction"), "ttb"), False).to_numpy(zero_copy_only=False), page)
    _right_to_left(page, flat.field("text"), bad)
    if not n:
        none = np.zeros(0, int)
        return Found(~broken, none, none, none, none, none, none, none, (x, y, w, h), none, x, (x, x, x))

    # rows in paint order
    opens = np.diff(page, prepend=-1) > 0
    step = np.diff(y, prepend=np.nan)
    bad(~opens & (step != 0) & (np.abs(step) <= tolerance), page)
    back = np.append(0.0, x[:-1] - np.maximum(tolerance, 0.25 * size[:-1]))
    breaks = opens | (step != 0) | ~(x >= back)
    first = np.flatnonzero(breaks)
    row_page, row_of = page[first], np.cumsum(breaks) - 1
    left, low = np.minimum.reduceat(x, first), np.minimum.reduceat(y, first)
    wide, tall = np.maximum.reduceat(x + w, first) - left, np.maximum.reduceat(y + h, first) - low
    middle, gap = low[1:] + tall[1:] / 2, left[1:] - (left[:-1] + wide[:-1])
    raised = (tall[1:] <= 0.85 * tall[:-1]) & (low[:-1] - tolerance <= middle) & (middle <= low[:-1] + tall[:-1] + tolerance)
    raised &= (-tolerance <= gap) & (gap <= 1.5 * tall[:-1]) & (row_page[1:] == row_page[:-1])
    bad(raised, row_page[1:])
    order = np.lexsort((y[first], row_page))
    base, of = y[first][order], row_page[order]
    bad((of[1:] == of[:-1]) & (np.abs(np.diff(base)) <= tolerance), of[1:])

    # cells of lines
    span = np.lexsort((x, row_of))
    x, y, w, h, size = (v[span] for v in (x, y, w, h, size))
    cut = breaks | ~(x - np.append(0.0, x[:-1] + w[:-1]) <= np.maximum(18, 2 * size))
    number = np.add.reduceat(cut.astype(int), first)
    many = number >= o.minimum_columns
    spans_in = np.diff(np.append(first, n))
    bad(many & (number != spans_in), row_page)
    right = x + ((x + w) - x)

    # runs of rows that fit their first one
    rows, column = np.arange(len(first)), np.arange(n) - first[row_of]
    top = np.append(True, row_page[1:] != row_page[:-1])
    new = ~many | top | ~np.append(False, many[:-1])
    for k in range(MOST_CUTS + 1):
        start = np.maximum.accumulate(np.where(new, rows, 0))
        misfit = number != number[start]
        told = ~misfit[row_of] & many[row_of] & (spans_in == number)[row_of] & (spans_in == number)[start][row_of]
        mine = np.flatnonzero(told)
        other = first[start[row_of[mine]]] + column[mine]
        apart = ~((np.abs(x[mine] - x[other]) <= o.column_tolerance) | (np.abs(right[mine] - right[other]) <= o.column_tolerance))
        misfit[row_of[mine[apart]]] = True
        misfit &= many & ~broken[row_page]
        if not misfit.any():
            break
        if k == MOST_CUTS:
            bad(misfit, row_page)
            break
        at = np.flatnonzero(misfit)
        new[at[np.unique(start[at], return_index=True)[1]]] = True
    length = np.bincount(start[many], minlength=len(first))[start]
    tabled = many & (length >= max(1, o.minimum_rows))
    some = np.zeros(pages, bool)
    some[row_page[tabled]] = True
    bad(~tabled & some[row_page], row_page)

    # words of two columns that begin near each other could make one more column
    held = np.flatnonzero(tabled[row_of] & ~broken[page])
    slot = first[start[row_of[held]]] + column[held]
    least, most = np.full(n, np.inf), np.full(n, -np.inf)
    np.minimum.at(least, slot, x[held])
    np.maximum.at(most, slot, x[held])
    close = (least[1:] - most[:-1] <= 0.2 * o.column_tolerance) & (row_of[1:] == row_of[:-1])
    bad(close & np.isfinite(least[1:]) & np.isfinite(most[:-1]), page[1:])

    # two columns that may be prose
    opening = np.flatnonzero((start == rows) & tabled & (number == 2) & (length >= 4))
    if len(opening):
        seconds = flat.field("text").take(_indices(span[first[opening] + 1])).to_pylist()
        bad(np.array([(t or "").strip()[:1].islower() for t in seconds], bool), row_page[opening])

    held = np.flatnonzero(tabled[row_of] & ~broken[page])
    row = row_of[held]
    begins = start[row]
    is_first = np.cumsum((start == rows) & tabled)
    # tables of a page before it, so that they are numbered from 0
    page_first = np.searchsorted(row_page, row_page[begins])
    table = is_first[begins] - 1 - np.append(0, is_first)[page_first]
    box = (x[held], y[held], (x + w)[held] - x[held], (y + h)[held] - y[held])
    return Found(~broken, span[held], page[held], table, row - begins, column[held], begins, number[begins], box, span[held] - np.asarray(ends)[page[held]], size[held], (left[row], low[row], tall[row]))


def _indices(values: np.ndarray):
    import pyarrow as pa

    return pa.array(values, pa.int64())


def _lists(begins: np.ndarray, columns: np.ndarray, cells: np.ndarray):
    """Offsets of one list of length ``columns`` a cell, and places in ``cells`` that fill them."""
    offsets = np.append(0, np.cumsum(columns))
    return offsets, np.repeat(cells, columns) + (np.arange(offsets[-1]) - np.repeat(offsets[:-1], columns))


def cell_columns(batch, flat, found: Found, wanted: list[str]) -> dict:
    """The wanted columns of ``page.CELLS`` as Arrow arrays."""
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(found.span)
    one = lambda v, kind: pa.repeat(pa.scalar(v, kind), n)

    def columns():
        # the first row of a table lies where its cells begin
        opening = np.flatnonzero((found.row == 0) & (found.column == 0))
        at = opening[np.searchsorted(found.begins[opening], found.begins)]
        offsets, places = _lists(found.begins, found.columns, at)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found.box[0][places]))

    make = {
        "doc_id": lambda: batch.column(0).take(_indices(found.page)),
        "page": lambda: batch.column(1).take(_indices(found.page)),
        "table_seq": lambda: pa.array(found.table, pa.int32()),
        "row": lambda: pa.array(found.row, pa.int32()),
        "column": lambda: pa.array(found.column, pa.int32()),
        "row_span": lambda: one(1, pa.int32()),
        "column_span": lambda: one(1, pa.int32()),
        "text": lambda: pc.utf8_trim_whitespace(pc.fill_null(flat.field("text").take(_indices(found.span)), "")),
        "bounds": lambda: pa.StructArray.from_arrays([pa.array(v) for v in found.box], ["x", "y", "width", "height"]),
        "span_seqs": lambda: pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), pa.array(found.seq, pa.int32())),
        "columns": columns,
        "reason": lambda: one("repeated-column-alignment", pa.string()),
        "caption": lambda: pa.nulls(n, pa.string()),
    }
    return {c: make[c]() for c in wanted}


def _page_of_one_table(batch, flat, found: Found) -> np.ndarray:
    """Plain pages that are empty or one table of simple texts in a face of no weight of its own."""
    import pyarrow.compute as pc

    counts = batch.column(4).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    page = np.repeat(np.arange(len(batch)), counts)
    out = found.plain & ((counts == 0) | (np.bincount(found.page, minlength=len(batch)) > 0))
    out[found.page[found.table > 0]] = False
    simple = pc.match_substring_regex(pc.fill_null(flat.field("text"), ""), SIMPLE_TEXT).to_numpy(zero_copy_only=False)
    out[page[~simple]] = False
    faces = pc.fill_null(flat.field("font_family"), "").dictionary_encode()
    heavy = np.array([WEIGHTED.search(v) is not None for v in faces.dictionary.to_pylist()] or [False])
    out[page[heavy[faces.indices.to_numpy()]]] = False
    return out


def block_columns(batch, flat, found: Found, wanted: list[str]) -> dict:
    """``page.BLOCKS`` of the plain pages that are one table, as Arrow arrays; no other page stays plain."""
    import pyarrow as pa
    import pyarrow.compute as pc

    found.plain = _page_of_one_table(batch, flat, found)
    kept = found.plain[found.page]
    span, page, row, column = (v[kept] for v in (found.span, found.page, found.row, found.column))
    x, size, line = found.box[0][kept], found.size[kept], [v[kept] for v in found.line]
    rows, tables = np.flatnonzero(column == 0), np.flatnonzero((column == 0) & (row == 0))
    n, first = len(tables), np.searchsorted(rows, tables)
    last = np.append(tables[1:], len(span)) - 1 if n else tables
    text = flat.field("text").take(_indices(span))
    by_row = pa.array(np.append(rows, len(span)), pa.int32())
    by_table = pa.array(np.append(first, len(rows)), pa.int32())
    cells = pa.ListArray.from_arrays(by_row, text)
    number = pc.match_substring_regex(text, r"\A[0-9., ]+\z").to_numpy(zero_copy_only=False)
    word = pc.match_substring_regex(text, "[A-Za-z]").to_numpy(zero_copy_only=False)
    headed = np.zeros(0, bool)
    if n:
        headed = np.logical_and.reduceat((row > 0) | (word & ~number), tables) & np.logical_or.reduceat((row > 0) & number, tables)
    is_header = np.zeros(len(rows), bool)
    is_header[first[headed]] = True
    wrapped = lambda a, between, b: pc.binary_join_element_wise(a, pc.binary_join(cells, between), b, "")
    head, body = wrapped('<tr><th scope="col">', '</th><th scope="col">', "</th></tr>"), wrapped("<tr><td>", "</td><td>", "</td></tr>")
    told = pa.StructArray.from_arrays(
        [pc.if_else(pa.array(is_header), head, body), wrapped("| ", " | ", " |"), pa.array(np.zeros(len(rows), bool)), cells], ["html", "md", "full", "cells"]
    )
    lines = pa.StructArray.from_arrays([pc.binary_join(cells, " "), *(pa.array(v[rows]) for v in line)], ["text", "x", "y", "height"])
    opening = cells.take(_indices(first))
    never = pa.array(np.zeros(n, bool))
    table = pa.StructArray.from_arrays(
        [
            pa.ListArray.from_arrays(by_row, pa.array(x)).take(_indices(first)), cells.take(pa.array(first, pa.int64(), mask=~headed)), opening, pa.nulls(n, pa.string()), never, never,
            pa.ListArray.from_arrays(by_table, told),
        ],
        ["columns", "header", "first", "caption", "spanning", "footer", "rows"],
    )
    of = lambda k: batch.column(k).take(_indices(page[tables]))
    family = pc.fill_null(flat.field("font_family"), "")
    out = {
        "doc_id": of(0), "page": of(1), "width": pc.fill_null(of(2), 0.0), "height": pc.fill_null(of(3), 0.0), "block_seq": pa.array(np.zeros(n, int)),
        "block_type": pa.array(["table"] * n, pa.string()), "text": pa.array([""] * n, pa.string()),
        "items": pa.array([[]] * n, pa.list_(pa.struct([("term", pa.string()), ("text", pa.string())]))), "lines": pa.ListArray.from_arrays(by_table, lines),
        "family": family.take(_indices(span[tables])), "size": pa.array(size[tables]), "last_family": family.take(_indices(span[last])), "last_size": pa.array(size[last]), "table": table,
    }
    return {c: out[c] if c in out else pa.nulls(n) for c in wanted}
