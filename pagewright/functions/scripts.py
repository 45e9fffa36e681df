"""Spans of right-to-left lines in reading order, as plain functions of span rows."""

from __future__ import annotations

import re

ARABIC, HEBREW = re.compile("[؀-ࣿﭐ-﷿ﹰ-﻿]"), re.compile("[֐-׿]")
RIGHT_TO_LEFT = re.compile("[֐-ࣿיִ-﷿ﹰ-﻿]")


def is_rtl(c: str) -> bool:
    return "֐" <= c <= "ࣿ" or "יִ" <= c <= "﷿" or "ﹰ" <= c <= "﻿"


def citation(text: str) -> str | None:
    """A parenthesised Hebrew citation with numbers on both sides, put back in order."""
    m = re.fullmatch(r"\)\s*([֐-׿][֐-׿\s]*?)(\d+)\(([֐-׿]+)\(\)(\d+)([֐-׿][֐-׿\s]*)", text)
    return f"{m[5]}{m[4]}({m[3]})({m[2]}) {m[1]}" if m else None


def in_script_order(spans: list[dict]) -> list[dict]:
    """Spans of one baseline that are mostly right-to-left, with their letters in reading order:
    chunks from the last to the first, but for Arabic, which is painted in order."""
    out: list[dict] = []
    at = 0
    while at < len(spans):
        end = at + 1
        while end < len(spans) and abs(spans[end]["bounds"]["y"] - spans[at]["bounds"]["y"]) <= 0.25:
            end += 1
        row, at = spans[at:end], end
        if any(s.get("direction") == "rtl" for s in row):  # in order already
            out += row
            continue
        text = "".join(s["text"] for s in row)
        rtl = sum(map(is_rtl, text))
        strong = rtl + len(re.findall("[A-Za-z]", text))
        if not rtl or 2 * rtl < strong:
            out += row
            continue
        left = min(s["bounds"]["x"] for s in row)
        keep = ARABIC.search(text) and not HEBREW.search(text)
        turned = [s | {"text": s["text"][::-1] if any(map(is_rtl, s["text"])) else s["text"], "direction": "rtl"} for s in (row if keep else row[::-1])]
        first = turned[0]
        inset = 0.035 * first["font_size"] if HEBREW.search(text) and re.search(r"\s", text) else 0.0
        if (mixed := citation("".join(s["text"] for s in turned))) is not None:
            same = len({s.get("href") for s in turned}) == 1
            out.append(first | {"text": mixed, "href": first.get("href") if same else None, "bounds": first["bounds"] | {"x": left}})
            continue
        turned[0] = first | {"bounds": first["bounds"] | {"x": left + inset}}
        out += turned
    return out
