"""Reading columns, covered widths and character grids of a page, over arrays of its spans.

A page's spans are arrays ordered by line; runs, clusters of left edges and gutters are marks, reductions and
quantiles of these, and the reading order is one sort.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

import numpy as np

# fixed values: distances in points or shares of the page's width, and counts, that decide results
BRIDGE = 2.0
LEAST_GAP, GAP_SHARE, GAP_HEIGHTS = 8.0, 0.015, 1.25
LEAST_NEAR, SUPPORT_SHARE, LEAST_SUPPORT = 4.0, 0.12, 4
COLUMN_SHARE, MOST_COLUMNS = 0.12, 4
#: Fewer runs make no two columns.
LEAST_RUNS = 2 * LEAST_SUPPORT
LEAST_HEIGHTS, MARGIN_HEIGHTS = 3.0, 1.5
EDGE_QUANTILE = 0.8
USUAL_HEIGHT = (0.9, 1.1)


def covered(intervals) -> float:
    """Length of the union of intervals right of zero; gaps of up to 2 points are bridged, one at zero too."""
    pairs = np.array([(0.0, 0.0), *intervals], float)
    left = np.maximum(pairs[:, 0], 0.0)
    order = np.lexsort((pairs[:, 1], left))
    left, reach = left[order], np.maximum.accumulate(pairs[order, 1])
    opens = np.flatnonzero(np.concatenate(([True], left[1:] > reach[:-1] + BRIDGE)))
    ends = np.append(opens[1:], len(left)) - 1
    return float(np.maximum(reach[ends] - left[opens], 0.0).sum())


def middle(values: np.ndarray) -> float:
    """The upper middle value; 0 for none."""
    return float(np.partition(values, len(values) // 2)[len(values) // 2]) if len(values) else 0.0


@dataclass
class Spans:
    """Spans of a page in the order of its lines, and by row the line of each."""

    line: np.ndarray
    x: np.ndarray
    y: np.ndarray
    right: np.ndarray
    top: np.ndarray

    @staticmethod
    def of(lines) -> Spans:
        rows = [(k, s.x, s.y, s.x + s.width, s.y + s.height) for k, line in enumerate(lines) for s in line.spans]
        table = np.array(rows, float).reshape(-1, 5)
        return Spans(table[:, 0].astype(int), *table[:, 1:].T)

    def where(self, kept: np.ndarray) -> Spans:
        return Spans(self.line[kept], self.x[kept], self.y[kept], self.right[kept], self.top[kept])

    def starts_of_runs(self, width: float) -> np.ndarray:
        """Where a line begins, or goes on after a gap as wide as between columns."""
        if not len(self.line):
            return np.zeros(0, int)
        new = np.diff(self.line, prepend=-1) != 0
        at, height = np.flatnonzero(new), self.top - self.y
        ranked = height[np.lexsort((height, self.line))]
        tall = ranked[at + np.diff(np.append(at, len(new))) // 2]  # each line's upper middle height
        wide = np.maximum(max(LEAST_GAP, GAP_SHARE * width), GAP_HEIGHTS * tall)[np.cumsum(new) - 1]
        new[1:] |= self.x[1:] - self.right[:-1] >= wide[1:]
        return np.flatnonzero(new)

    def boxes(self, at: np.ndarray) -> Spans:
        """The least box around each stretch that begins at ``at``."""
        if not len(at):
            return self
        return Spans(self.line[at], np.minimum.reduceat(self.x, at), np.minimum.reduceat(self.y, at), np.maximum.reduceat(self.right, at), np.maximum.reduceat(self.top, at))


@dataclass
class Layout:
    starts: np.ndarray
    bottom: float
    top: float

    def column(self, x: np.ndarray) -> np.ndarray:
        """The column whose start is nearest, the left one of equals."""
        return np.abs(x[:, None] - self.starts).argmin(axis=1)

    def gutters(self, runs: Spans) -> np.ndarray:
        """Half way between a column's start and the farthest run that ends before it in the column to its left."""
        own = self.column(runs.x)
        ends = [np.append(runs.right[(own == k) & (runs.right < start)], self.starts[k]).max() for k, start in enumerate(self.starts[1:])]
        return (np.array(ends) + self.starts[1:]) / 2


def layout(runs: Spans, width: float) -> Layout | None:
    """Columns where left edges of runs recur side by side over some height, with gutters between."""
    if len(runs.x) < LEAST_RUNS:
        return None
    order = np.argsort(runs.x, kind="stable")
    x = runs.x[order]
    cluster = np.cumsum(np.diff(x, prepend=x[0]) > max(LEAST_NEAR, GAP_SHARE * width))
    count = np.bincount(cluster)
    first = np.cumsum(count) - count
    table = np.stack([x[first + count // 2], count, np.arange(len(count))], axis=1)
    table = table[count >= max(LEAST_SUPPORT, int(np.ceil(SUPPORT_SHARE * len(x))))]
    # of two clusters too close for columns the one with more runs stays, the left one of equals
    while len(close := np.flatnonzero(np.diff(table[:, 0]) < COLUMN_SHARE * width)):
        k = close[0]
        table = np.delete(table, k if table[k + 1, 1] > table[k, 1] else k + 1, axis=0)
    if not 2 <= len(table) <= MOST_COLUMNS:
        return None
    members = [order[cluster == c] for c in table[:, 2]]
    bottom, top = max(runs.y[m].min() for m in members), min(runs.top[m].max() for m in members)
    tall = middle(np.concatenate([(runs.top - runs.y)[m] for m in members]))
    if top - bottom < LEAST_HEIGHTS * tall:
        return None
    for m, start in zip(members, table[1:, 0], strict=False):
        ends = np.sort(runs.right[m][runs.right[m] < start])
        if not len(ends) or start - ends[int(EDGE_QUANTILE * len(ends))] < max(LEAST_GAP, GAP_SHARE * width):
            return None
    return Layout(table[:, 0], bottom - MARGIN_HEIGHTS * tall, top + MARGIN_HEIGHTS * tall)


def found(runs: Spans, width: float) -> Layout | None:
    """The layout of all runs if it has three columns or more, else that of the runs of usual height."""
    every = layout(runs, width)
    if every is not None and len(every.starts) > 2:
        return every
    height = runs.top - runs.y
    body = middle(height)
    return layout(runs.where((height >= USUAL_HEIGHT[0] * body) & (height <= USUAL_HEIGHT[1] * body)), width)


def pieces(spans: Spans, lines: int, fixed: np.ndarray, at: Layout, gutters: np.ndarray) -> list[tuple[np.ndarray, int | None, bool]]:
    """Stretches of spans in reading order, as (places of spans, line or None, opens a column).

    A line that is ``fixed`` (of a table, outside the columns' height, or over a gutter) stays whole and parts
    regions; inside a region pieces are read column by column, top down."""
    over = ((spans.x[:, None] < gutters) & (spans.right[:, None] > gutters)).any(axis=1)
    fixed = fixed | np.bincount(spans.line[over], minlength=lines).astype(bool)
    region = np.cumsum(fixed)
    whole = fixed[spans.line]
    column = np.where(whole, 0, at.column(spans.x))
    by = np.lexsort((spans.x, column, spans.line))
    new = np.flatnonzero((np.diff(spans.line[by], prepend=-1) != 0) | (np.diff(column[by], prepend=-1) != 0))
    held = np.split(by, new[1:]) if len(new) else []
    lead = by[new]
    line, column = spans.line[lead], column[lead]
    y, x = (np.minimum.reduceat(v[by], new) if len(new) else v[:0] for v in (spans.y, spans.x))
    down = np.where(whole[lead], 0.0, -y)
    order = np.lexsort((line, np.where(whole[lead], 0.0, x), down, column, ~fixed[line], region[line]))
    out, seen = [], set()
    for k in order.tolist():
        place = (int(region[line[k]]), int(column[k]))
        opens = not fixed[line[k]] and place[1] > 0 and place not in seen
        seen.add(place)
        out.append((held[k], int(line[k]) if fixed[line[k]] else None, opens))
    return out


def in_grid(rows: list[list[tuple[float, str]]], origin: float, wide: float) -> str:
    """Lines of (x, text) with as many spaces as their places on a grid of ``wide`` points ask for."""
    out = []
    for row in rows:
        places = [max(0, int(np.floor((x - origin) / wide + 0.5))) for x, _ in row]
        ends = list(accumulate(zip(places, row, strict=True), lambda end, s: max(end, s[0]) + len(s[1][1]), initial=0))
        out.append("".join(" " * max(0, place - end) + text for place, end, (_, text) in zip(places, ends, row, strict=False)).rstrip())
    return "\n".join(out)
