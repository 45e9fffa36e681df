"""Repeated furniture over a stream of pages, with a bounded look-ahead."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "doc_id string, page int, line_seq int, text string, suppressed boolean"


def signature(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[0-9]+", "#", text.lower())).strip()


def suppressed(lines: DataFrame, lookahead: int = 4, patience: str | None = None) -> DataFrame:
    """``lines`` (doc_id, page, line_seq, text, margin; streaming) with suppressed, page by page.

    A document's state is its last ``lookahead`` - 1 pages and the margin signatures seen; a page
    leaves it as soon as the pages it looks ahead to are there, or at a row whose page is null, which
    ends the document. With ``patience`` (a duration), a document that has had no row for so long ends
    too. A page's lines arrive in one batch, pages in order.
    """

    def step(key, frames: Iterator, state: GroupState):
        import pandas as pd

        held = json.loads(state.get[0]) if state.exists else {"pages": {}, "seen": []}
        pages, seen, ended = {int(k): v for k, v in held["pages"].items()}, set(held["seen"]), state.hasTimedOut
        for f in frames:
            for page, seq, text, margin in zip(f["page"], f["line_seq"], f["text"], f["margin"], strict=True):
                if pd.isna(page):
                    ended = True
                else:
                    pages.setdefault(int(page), []).append((int(seq), text, bool(margin)))
        out, newest = [], max(pages, default=0)
        for p in sorted(pages):
            if not ended and p + lookahead - 1 > newest:
                break
            ahead = {signature(t) for q in pages if p < q < p + lookahead for _, t, m in pages[q] if m}
            for seq, text, margin in sorted(pages[p]):
                out.append((key[0], p, seq, text, margin and signature(text) in seen | ahead))
            seen |= {signature(t) for _, t, m in pages.pop(p) if m}
        if ended:
            state.remove()
        else:
            state.update((json.dumps({"pages": pages, "seen": sorted(seen)}),))
            if patience:
                state.setTimeoutDuration(patience)
        yield pd.DataFrame(out, columns=["doc_id", "page", "line_seq", "text", "suppressed"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if patience else GroupStateTimeout.NoTimeout
    chosen = lines.selectExpr("doc_id", "cast(page as int) as page", "cast(line_seq as int) as line_seq", "text", "margin")
    return chosen.groupBy("doc_id").applyInPandasWithState(step, OUT, "held string", "append", timeout)
