"""Captions of pictures: the pairs of a page's pictures and paragraphs as one table, a plane a term.

Terms are arrays (pictures, paragraphs); the score is their weighted sum, and a pair that is the best of its row and
of its column is taken.
"""

from __future__ import annotations

import numpy as np

# fixed values: the weights of a score's terms, the score that is enough, and what nearly is
WEIGHTS = {"gap": 0.22, "overlap": 0.17, "centre": 0.13, "width": 0.09, "font": 0.13, "space": 0.09, "clear": 0.09, "repeated": 0.08}
LEAST_SCORE, PATTERN_SLACK = 0.72, 0.08
# fixed values: what rules a pair out, and the steps of two terms
OUTSIDE, LEAST_WIDTH, LEAST_HEIGHT = 2.0, 0.06, 1.5
OVERSTEP, GAP_LINES, GAP_SHARE = 0.15, 3.0, 0.035
LEAST_OVERLAP, LEAST_CENTRE, LEAST_NEAR_ABOVE = 0.45, 0.82, 0.6
BETWEEN_SHARE, CLEAR = 0.25, (1.0, 0.35, 0.0)
FONT_OTHER, FONT_SIZE, FONT_SAME, SIZE_STEP = 1.0, 0.65, 0.15, 0.75
SPACE_LINES = 0.25


def _boxes(items) -> np.ndarray:
    """x, y, right, top by row."""
    return np.array([(b.x, b.y, b.x + b.width, b.y + b.height) for b in items], float).reshape(-1, 4)


def _meet(a0, a1, b0, b1) -> np.ndarray:
    """How much of two intervals is common."""
    return np.maximum(0.0, np.minimum(a1, b1) - np.maximum(a0, b0))


def _unit(v: np.ndarray) -> np.ndarray:
    return np.clip(v, 0.0, 1.0)


def _middle(values: np.ndarray, none: float) -> float:
    return float(np.sort(values)[len(values) // 2]) if len(values) else none


class Page:
    """A page's lines as arrays: their boxes, and of each span its line, font (numbered as first seen), size and weight."""

    def __init__(self, lines, font):
        self.box = _boxes(lines)
        self.number = {id(x): k for k, x in enumerate(lines)}
        rows = [(k, font(s), s.size, max(1, len(s.text))) for k, x in enumerate(lines) for s in x.spans]
        self.fonts: dict = {}
        for _, f, _, _ in rows:
            self.fonts.setdefault(f, len(self.fonts))
        self.line = np.array([r[0] for r in rows], int)
        self.font = np.array([self.fonts[r[1]] for r in rows], int)
        self.size = np.array([r[2] for r in rows], float)
        self.weight = np.array([r[3] for r in rows], int)

    def font_term(self, own: np.ndarray, font) -> float:
        """How a paragraph's first font stands out from the one that most of the other text has."""
        other = ~np.isin(self.line, np.flatnonzero(own))
        total = np.bincount(self.font[other], self.weight[other], minlength=len(self.fonts))
        if not total.any():
            return FONT_OTHER
        seen = np.full(len(self.fonts), len(self.line))
        np.minimum.at(seen, self.font[other], np.flatnonzero(other))
        usual = min(np.flatnonzero(total == total.max()), key=lambda f: seen[f])
        if self.fonts.get(font, -1) != usual:
            return FONT_OTHER
        away = _middle(self.size[~other], 0.0) - _middle(self.size[other], 0.0)
        return FONT_SIZE if abs(away) >= SIZE_STEP else FONT_SAME


def scores(pictures, texts, lines, width: float, height: float, font) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score without repetition, -inf where a pair cannot be; 1 where the text is below; width ratio in quarters)."""
    page = Page(lines, font)
    m, c = _boxes(pictures)[:, None, :], np.stack([_around(_boxes(b.lines)) for b in texts])[None]
    own = np.array([np.isin(np.arange(len(lines)), [page.number[id(x)] for x in b.lines if id(x) in page.number]) for b in texts])
    tall = np.array([_middle(np.array([x.height for x in b.lines]), 0.0) or 1.0 for b in texts])
    (mx, my, mr, mt), (cx, cy, cr, ct) = np.moveaxis(m, 2, 0), np.moveaxis(c, 2, 0)
    mw, mh, cw, ch = mr - mx, mt - my, cr - cx, ct - cy

    fits = (np.minimum(mx, my) >= -OUTSIDE) & (mr <= width + OUTSIDE) & (mt <= height + OUTSIDE) & (mw >= LEAST_WIDTH * width) & (mh >= LEAST_HEIGHT * tall)
    below, above = my - ct >= -OVERSTEP * ch, cy - mt >= -OVERSTEP * ch
    above &= ~below
    gap = np.maximum(0.0, np.where(below, my - ct, cy - mt))
    most = np.maximum(GAP_LINES * tall, GAP_SHARE * height)
    overlap = _meet(mx, mr, cx, cr) / np.maximum(1.0, np.minimum(mw, cw))
    centre = _unit(1 - np.abs((mx + mr) / 2 - (cx + cr) / 2) / np.maximum(mw, cw))
    fits &= (below | above) & (gap <= most) & ((overlap >= LEAST_OVERLAP) | (centre >= LEAST_CENTRE))
    near = _unit(1 - gap / most)

    # third axis: the page's lines
    lx, ly, lr, lt = (page.box[:, k] for k in range(4))
    other = ~own[None]
    low, high = np.where(below, ct, mt)[..., None], np.where(below, my, cy)[..., None]
    beside = (_meet(lx, lr, mx[..., None], mr[..., None]) / np.maximum(1.0, np.minimum(lr - lx, mw[..., None]))) >= BETWEEN_SHARE
    between = (other & (ly < high) & (lt > low) & beside).sum(axis=2)
    clear = np.array(CLEAR)[np.minimum(between, len(CLEAR) - 1)]
    fits &= (clear > 0) & (below | ((near >= LEAST_NEAR_ABOVE) & (clear == 1)))

    under, over = cy[..., None] - lt, ly - ct[..., None]
    away = np.where(below[..., None], under, over)
    away = np.where(other & (_meet(lx, lr, cx[..., None], cr[..., None]) > 0) & (away >= 0), away, np.inf).min(axis=2, initial=np.inf)
    with np.errstate(invalid="ignore"):
        space = np.where(np.isinf(away), 1.0, _unit((away + SPACE_LINES * tall) / (gap + tall)))
    told = np.array([page.font_term(own[j], next(font(s) for x in b.lines for s in x.spans if s.text.strip())) for j, b in enumerate(texts)])
    ratio = np.minimum(mw, cw) / np.maximum(np.maximum(mw, cw), 1e-300)
    terms = {"gap": near, "overlap": overlap, "centre": centre, "width": ratio, "font": np.broadcast_to(told, fits.shape), "space": space, "clear": clear}
    score = np.tensordot([WEIGHTS[k] for k in terms], np.stack([np.broadcast_to(v, fits.shape) for v in terms.values()]), 1)
    return np.where(fits, score, -np.inf), np.broadcast_to(below, fits.shape), np.floor(4 * cw / np.maximum(1.0, mw) + 0.5)


def _around(boxes: np.ndarray) -> np.ndarray:
    return np.concatenate((boxes[:, :2].min(axis=0), boxes[:, 2:].max(axis=0)))


def matched(pictures, texts, lines, width: float, height: float, font) -> list[tuple[int, int]]:
    """(picture, paragraph) of those that are each other's best, at ``LEAST_SCORE`` or more.

    What nearly passes twice in one way on a page (first font, side, relative width) counts as a pattern."""
    if not pictures or not texts:
        return []
    score, below, ratio = scores(pictures, texts, lines, width, height, font)
    fonts: dict = {}
    first = np.array([fonts.setdefault(font(b.lines[0].spans[0]), len(fonts)) for b in texts])
    way = np.stack([np.broadcast_to(v, score.shape).astype(float) for v in (first, below, ratio)], axis=2).reshape(-1, 3)
    _, kind = np.unique(way, axis=0, return_inverse=True)
    nearly = (score >= LEAST_SCORE - PATTERN_SLACK).ravel()
    often = np.bincount(kind.ravel()[nearly], minlength=kind.max() + 1)[kind.ravel()].reshape(score.shape) >= 2
    score = score + WEIGHTS["repeated"] * often
    score[score < LEAST_SCORE] = -np.inf
    best = score.argmax(axis=1)
    rows = np.arange(len(pictures))
    mutual = np.isfinite(score[rows, best]) & (score.argmax(axis=0)[best] == rows)
    return [(int(i), int(best[i])) for i in rows[mutual]]
