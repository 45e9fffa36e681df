"""Text predicates and renderings as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns that decide results
NUMERIC_FIELD = r"^(?:\p{Sc}\s*)?[\d.,'’\s]+(?:\s*%)?$"
BULLET = r"^\s*[•●▪◦]\s*(.+)$"
ORDERED = r"^\s*\d+[.)]\s+(.+)$"
SAFE_URI = r"(?i)^(?:https?:|mailto:)[^\x00-\x20\x7f]*$"
BOLD = r"(?i)bold|semibold|demi|medium|medi"
BOLD_HEADING = r"(?i)bold|semibold|demi|medi"
MONO = r"(?i)courier|mono|typewriter|cmtt"
ITALIC = r"(?i)italic|oblique|slanted|slant|ital"
NUMBERED = r"^\d+(?:\.\d+)*\.?(?:\s+|$)"
HYPHEN_TERM = r"[\p{L}\p{N}]+(?:[-‐‑][\p{L}\p{N}]+)+"
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﳋ": "لخ"}
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
# heading sizes: the largest text, then ratios to the body size
LARGEST_SHARE, TOP_RATIO = 0.94, 1.35
HEADING_RATIOS = ((1.7, 1), (1.5, 2), (1.35, 3), (1.15, 4))
BOLD_RATIO = 1.08


def is_numeric_field(c: Column) -> Column:
    return F.trim(c).rlike(NUMERIC_FIELD)


def is_bold(family: Column) -> Column:
    return F.coalesce(family.rlike(BOLD), F.lit(False))


def is_monospace(family: Column) -> Column:
    return F.coalesce(family.rlike(MONO), F.lit(False))


def is_italic(family: Column) -> Column:
    return F.coalesce(family.rlike(ITALIC), F.lit(False))


def list_marker(c: Column) -> Column:
    """struct<ordered, text>: a list item and the text after its marker; null for other text."""
    item = lambda pattern, ordered: F.when(c.rlike(pattern), F.struct(F.lit(ordered).alias("ordered"), F.regexp_extract(c, pattern, 1).alias("text")))
    return F.coalesce(item(BULLET, False), item(ORDERED, True))


def safe_uri(c: Column) -> Column:
    """A web or mail address, trimmed; null for anything else."""
    trimmed = F.trim(c)
    return F.when(trimmed.rlike(SAFE_URI), trimmed)


def compatible(c: Column) -> Column:
    """Control characters as spaces, ligatures as their letters."""
    c = F.regexp_replace(c, CONTROLS, " ")
    for a, b in LIGATURES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def tokens(c: Column) -> Column:
    """Words and single marks, white space dropped."""
    return F.regexp_extract_all(c, F.lit(TOKEN), 0)


def hyphen_terms(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(HYPHEN_TERM), 0)


def restore_hyphens(c: Column, terms: Column) -> Column:
    """``c`` with each of ``terms`` (sorted here) put back where its letters stand run together."""
    quoted = lambda t: F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.regexp_replace(t, "[-‐‑]", ""), F.lit(r"(?![\p{L}\p{N}])"))
    return F.aggregate(F.array_sort(F.array_distinct(terms)), c, lambda text, t: F.regexp_replace(text, quoted(t), t))


def title_case(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.concat(F.upper(F.substring(low, 1, 1)), F.substr(low, F.lit(2)))


def is_financial(items: Column) -> Column:
    """Entries that all read as numbers, some with a currency or a percent sign."""
    return (F.size(items) > 0) & F.forall(items, lambda x: is_numeric_field(x["text"])) & F.exists(items, lambda x: x["text"].rlike(r"\p{Sc}|%"))


def is_contact(c: Column) -> Column:
    """Two of: an at sign, a telephone number, a web address, a domain."""
    signs = (r"@", r"\+?\d[\d().\s-]{7,}", r"(?i)\bhttps?://", r"(?i)\b\w+\.\w{2,}\b")
    return sum((c.rlike(p).cast("int") for p in signs[1:]), c.rlike(signs[0]).cast("int")) >= 2


def furniture_signature(c: Column) -> Column:
    """Lower case, digit runs as one mark, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[0-9]+", "#"), r"\s+", " "))


def heading_level(size: Column, body: Column, largest: Column, bold: Column, text: Column) -> Column:
    """1 to 4 from the ratio of a line's size to the body size; null for body text."""
    ratio, t = size / body, F.trim(text)
    numbered = t.rlike(NUMBERED) & t.rlike("[A-Za-z]") & (F.size(F.split(t, r"\s+")) <= 6)
    level = F.when((size >= largest * LARGEST_SHARE) & (ratio >= TOP_RATIO), 1).when(numbered, F.when(ratio >= TOP_RATIO, 3).otherwise(4))
    for least, value in HEADING_RATIOS:
        level = level.when(ratio >= least, value)
    level = level.when(bold & (ratio >= BOLD_RATIO), 4)
    return F.when((F.length(t) > 0) & (F.length(t) <= 100), level)


def html_escape(c: Column) -> Column:
    """Markup characters as entities, control characters as U+FFFD, CR as LF."""
    c = F.regexp_replace(F.replace(c, F.lit("\r"), F.lit("\n")), CONTROLS, "\ufffd")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def markdown_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_\[\]<>])", r"\\$1")


def gfm_escape(c: Column) -> Column:
    """A table cell: Markdown's marks and bars escaped, line breaks as <br>."""
    return F.regexp_replace(F.replace(markdown_escape(c), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", "<br>")


def cmyk_hex(c: Column, m: Column, y: Column, k: Column) -> Column:
    part = lambda x: F.lpad(F.lower(F.hex(F.floor((1 - F.least(F.lit(1.0), x + k)) * 255 + 0.5))), 2, "0")
    return F.concat(F.lit("#"), part(c), part(m), part(y))


def ascii_hex(c: Column) -> Column:
    """Bytes of a hex string; white space is skipped and an odd digit is padded on the right."""
    digits = F.regexp_replace(F.regexp_extract(c, r"^([^>]*)", 1), r"\s", "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


# ------------------------------------------------------------------ plain functions of the page operators
def join_wrapped(before: str, now: str) -> str:
    """Two pieces of wrapped text: a hyphen at the end goes, unless its word holds a digit or another one."""
    if re.search(r"\S[-‐‑]$", before):
        word = before.split()[-1][:-1]
        return (before if re.search(r"[-‐‑\d]", word) else before[:-1]) + now.lstrip()
    return f"{before.rstrip()} {now.lstrip()}"


def join_lines(before: str, now: str) -> str:
    """``join_wrapped``, but a token of 20 characters takes a short lower-case tail without a space."""
    if not re.search(r"\S[-‐‑]$", before) and re.search(r"\S{20,}$", before) and re.fullmatch(r"[a-z]{1,4}[.,;:]?", now.strip()):
        return before + now.strip()
    return join_wrapped(before, now)


def escape_html(t: str) -> str:
    t = re.sub(CONTROLS, "\ufffd", t.replace("\r", "\n"))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = t.replace(a, b)
    return t


def escape_markdown(t: str) -> str:
    return re.sub(r"([\\`*_\[\]<>])", r"\\\1", t)


def escape_gfm(t: str) -> str:
    return re.sub(r"\s*\n\s*", "<br>", escape_markdown(t).replace("|", "\\|"))


def compatible_text(t: str) -> str:
    t = re.sub(CONTROLS, " ", t)
    for a, b in LIGATURES.items():
        t = t.replace(a, b)
    return t
