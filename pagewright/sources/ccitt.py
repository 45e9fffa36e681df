"""CCITT Group 4 images: two-dimensional run lengths, each line told by how its colour changes differ from the line above."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Pixels of a decoded image at most.
MOST_PIXELS = 8 << 20

# fixed values: the public codes of runs (0 to 63, then 64 to 1728 by 64, of white and of black, then 1792 to 2560 of both) and of modes
_WHITE = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 "
    "0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 "
    "00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 "
    "01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100 "
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 "
    "011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
)
_BLACK = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 "
    "00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 "
    "000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 "
    "000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 "
    "000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 "
    "000001100111 "
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 "
    "0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 "
    "0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
)
_BOTH = (
    "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 "
    "000000011110 000000011111"
)
MODES = {"pass": "0001", "runs": "001", 0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010", "end": "000000000001"}
_LONGEST = 13


def run_codes(black: bool) -> dict[int, str]:
    """Run length -> code."""
    lengths = [*range(64), *range(64, 1729, 64), *range(1792, 2561, 64)]
    return dict(zip(lengths, f"{_BLACK if black else _WHITE} {_BOTH}".split(), strict=True))


@lru_cache(4)
def _table(kind: str) -> list[tuple | None]:
    """What each 13 bits begin with: (meaning, bits)."""
    codes = MODES if kind == "modes" else run_codes(kind == "black")
    table: list[tuple | None] = [None] * (1 << _LONGEST)
    for meaning, code in codes.items():
        free = _LONGEST - len(code)
        first = int(code, 2) << free
        table[first : first + (1 << free)] = [(meaning, len(code))] * (1 << free)
    return table


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data + b"\0\0\0", 0
        self.end = 8 * len(data)

    def read(self, kind: str):
        """The next code's meaning; None where no code begins, or the data ends."""
        if self.at >= self.end:
            return None
        k, shift = divmod(self.at, 8)
        found = _table(kind)[int.from_bytes(self.data[k : k + 3]) >> (24 - _LONGEST - shift) & (1 << _LONGEST) - 1]
        if found is None:
            return None
        self.at += found[1]
        return found[0]

    def run(self, black: bool) -> int | None:
        """A run's length: codes of multiples of 64, and one below that."""
        total = 0
        while True:
            n = self.read("black" if black else "white")
            if n is None:
                return None
            total += n
            if n < 64:
                return total


def _line(bits: _Bits, above: list[int], width: int) -> list[int] | None:
    """The places where a line's colour changes, from those of the line above; None at the end or where a code is damaged."""
    out: list[int] = []
    at, black, k = -1, False, 0
    while at < width:
        # the first change above to the other colour, right of here
        while k > 0 and above[k - 1] > at:
            k -= 1
        while k < len(above) and (above[k] <= at or k % 2 != black):
            k += 1
        near = above[k] if k < len(above) else width
        mode = bits.read("modes")
        if mode == "pass":
            at = above[k + 1] if k + 1 < len(above) else width
        elif mode == "runs":
            one = bits.run(black)
            two = bits.run(not black) if one is not None else None
            if two is None:
                return None
            start = max(at, 0)
            out += [min(start + one, width), min(start + one + two, width)]
            at = start + one + two
        elif isinstance(mode, int):
            at = max(min(near + mode, width), out[-1] if out else 0)
            out.append(at)
            black = not black
        else:
            return None
    return out


def group4(data: bytes, width: int, height: int | None = None, black_is_1: bool = False) -> bytes:
    """Rows of packed bits. Damaged data end the image: lines that are missing are white; without ``height``, as many as there are."""
    from .pdf import PdfError

    if width < 1 or (height is not None and height < 1):
        raise PdfError("INVALID_PDF", "an image without a size")
    if width * (height or 1) > MOST_PIXELS:
        raise PdfError("RESOURCE_LIMIT", "an image decodes to too many pixels")
    bits, above, rows = _Bits(data), [], []
    while height is None or len(rows) < height:
        line = _line(bits, above, width)
        if line is None:
            break
        if (len(rows) + 1) * width > MOST_PIXELS:
            raise PdfError("RESOURCE_LIMIT", "an image decodes to too many pixels")
        turns = np.zeros(width + 1, np.uint8)
        np.add.at(turns, line, 1)
        rows.append(np.packbits(np.cumsum(turns[:width]).astype(np.uint8) & 1))
        above = line
    black = np.zeros((len(rows) if height is None else height, -(-width // 8)), np.uint8)
    if rows:
        black[: len(rows)] = rows
    if not black_is_1:
        black = ~black
        if width % 8:
            black[:, -1] &= 0xFF << (-width % 8) & 0xFF
    return black.tobytes()


def encoded(black: np.ndarray) -> bytes:
    """Group 4 data of a matrix of pixels (1: black), for layouts and tests."""
    out, above = [], []
    width = black.shape[1]
    for row in black:
        change = np.flatnonzero(np.diff(row.astype(np.int8), prepend=0)).tolist()
        at, colour = -1, 0
        while at < width:
            one = next((c for k, c in enumerate(change) if c > at and k % 2 == colour), width)
            near = next((k for k, c in enumerate(above) if c > at and k % 2 == colour), len(above))
            b1, b2 = (above[near] if near < len(above) else width), (above[near + 1] if near + 1 < len(above) else width)
            if b2 < one:
                out.append(MODES["pass"])
                at = b2
            elif abs(one - b1) <= 3:
                out.append(MODES[one - b1])
                at, colour = one, colour ^ 1
            else:
                two = next((c for c in change if c > one), width)
                start = max(at, 0)
                out.append(MODES["runs"])
                for n, dark in ((one - start, colour), (two - one, colour ^ 1)):
                    codes = run_codes(bool(dark))
                    while n > 2623:
                        out.append(codes[2560])
                        n -= 2560
                    if n > 63:
                        out.append(codes[n // 64 * 64])
                    out.append(codes[n % 64])
                at = two
        above = change
    out += [MODES["end"]] * 2
    bits = "".join(out)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8) if bits else b""
