"""Checks of rendered documents: what a page holds, how two versions differ, and contracts."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# fixed values: the parts of a page that are listed, by pattern and group
FACETS = {
    "headings": (r"(?s)<h[1-6][^>]*>(.*?)</h[1-6]>", 1),
    "lists": (r"<(?:ul|ol)[ >]", 0),
    "items": (r"<li[ >]", 0),
    "tables": (r"<table[ >]", 0),
    "captions": (r"(?s)<(?:caption|figcaption)[^>]*>(.*?)</(?:caption|figcaption)>", 1),
    "links": (r'<a [^>]*href="([^"]*)"', 1),
    "code": (r"<pre[ >]", 0),
    "definitions": (r"(?s)<dt[^>]*>(.*?)</dt>", 1),
    "header_cells": (r"(?s)<th[^>]*>(.*?)</th>", 1),
}
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def plain_text(html: Column) -> Column:
    """Text without tags, entities as their characters, white space collapsed."""
    c = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def inspect(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key``, the facets of each page as arrays, and its tokens."""
    held = [F.coalesce(F.regexp_extract_all(html, F.lit(p), g), F.array().cast("array<string>")).alias(name) for name, (p, g) in FACETS.items()]
    return pages.select(key, *held, T.tokens(plain_text(F.col(html))).alias("tokens"))


def multiset_difference(expected: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys``, missing and added: how many values one side has beyond the other. Values are counted
    on each side before they meet, so a frequent value is one row a side."""
    count = lambda df, sign: df.groupBy(*keys, value).agg((F.count(F.lit(1)) * sign).alias("n"))
    return net_difference(count(expected, 1).unionByName(count(actual, -1)), keys, value, "n")


def net_difference(signed: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """``multiset_difference`` of one relation whose ``n`` is positive for one side and negative for the other. Where it is dealt
    by ``keys`` already, it isn't shuffled again, and a task holds the values of its own keys alone."""
    net = signed.groupBy(*keys, value).agg(F.sum(n).alias("n"))
    return net.groupBy(*keys).agg(F.sum(F.greatest("n", F.lit(0))).alias("missing"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("added"))


def _common_length(one: list, two: list) -> int:
    """Length of the longest common subsequence, a row of the usual table at a time as one whole number.

    Bit i of the row is 0 where the table grows at place i of ``two``; a sum's carries move the growths, so a value
    costs a few operations on len(two) bits."""
    places: dict = {}
    for i, v in enumerate(two):
        places[v] = places.get(v, 0) | 1 << i
    full = (1 << len(two)) - 1
    row = full
    for v in one:
        met = row & places.get(v, 0)
        row = (row + met | row - met) & full
    return len(two) - row.bit_count()


def longest_common(expected: Column, actual: Column) -> Column:
    """Length of the longest common subsequence of two arrays; null if one of them is."""

    @F.pandas_udf("int")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _common_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return common(expected, actual)


def order_kept(expected: DataFrame, actual: DataFrame, key: str, tokens: str) -> DataFrame:
    """``key``, expected, actual (how many tokens), common and kept: the share of the expected tokens that stand in the same order.

    A side that is missing has no tokens; of none expected all are kept."""
    one, two = expected.select(key, F.col(tokens).alias("one")), actual.select(key, F.col(tokens).alias("two"))
    none = F.array().cast(expected.schema[tokens].dataType)
    met = one.join(two, key, "full").select(key, F.coalesce("one", none).alias("one"), F.coalesce("two", none).alias("two"))
    told = met.select(key, F.size("one").alias("expected"), F.size("two").alias("actual"), longest_common(F.col("one"), F.col("two")).alias("common"))
    return told.withColumn("kept", F.when(F.col("expected") == 0, 1.0).otherwise(F.col("common") / F.col("expected")))


def check(check_id: str, kind: str, values: Column, verified: bool) -> Column:
    """A contract of one of the kinds that ``judged`` knows."""
    return F.struct(F.lit(check_id).alias("check_id"), F.lit(kind).alias("kind"), values.alias("values"), F.lit(verified).alias("verified"))


def in_sequence(text: Column, parts: Column) -> Column:
    """Whether ``parts`` stand in ``text`` one after another."""
    place = lambda v, at: F.position(v, text, at)
    return F.aggregate(parts, F.lit(1), lambda at, v: F.when((at == 0) | (place(v, at) == 0), 0).otherwise(place(v, at) + F.length(v))) > 0


def _inner(html: Column, tag: str) -> Column:
    """What stands inside each element of a name (a pattern)."""
    return F.coalesce(F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{tag})(?:\s[^>]*)?>(.*?)</(?:{tag})>"), 1), F.array().cast("array<string>"))


_BLOCKS = "section|article|table|div|p|li|tr"


def judged(texts: DataFrame, checks: DataFrame) -> DataFrame:
    """``checks`` (doc_id, check_id, kind, values, verified) with passed, and blocks: verified and failed.
    A check of a document that is not there fails, and so does one of an unknown kind.

    Kinds over ``text``: contains, sequence, absent, noControls. Over ``html``, if ``texts`` has it: row (its cells, token by token),
    rowContains (cells in order), tableRows (at least so many in one table), flowParagraph (parts in a paragraph outside tables), group
    (an element's name, then parts in it), labelValue (both in one innermost block), mediaCaption (an element's name and the caption of its figure)."""
    met = checks.join(texts, "doc_id", "left")
    values, kind = F.col("values"), F.col("kind")
    text = F.coalesce("text", F.lit(""))
    rules = {
        "contains": F.forall(values, lambda v: text.contains(v)),
        "sequence": in_sequence(text, values),
        "absent": ~F.exists(values, lambda v: text.contains(v)),
        "noControls": ~text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"),
    }
    if "html" in texts.columns:
        html = F.coalesce("html", F.lit(""))
        rows = F.transform(_inner(html, "tr"), lambda r: F.transform(_inner(r, "t[hd]"), plain_text))
        same = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: T.tokens(x) == T.tokens(y)), lambda ok: F.coalesce(ok, F.lit(False)))
        # the next cell that holds a value stands behind the one before
        after = lambda row, v, at: F.array_min(F.filter(F.transform(row, lambda c, i: F.when((i >= at) & c.contains(v), i + 1)), lambda i: i.isNotNull()))
        ordered = lambda row: F.aggregate(values, F.lit(0), lambda at, v: F.when(at < 0, -1).otherwise(F.coalesce(after(row, v, at), F.lit(-1)))) >= 0
        flow = F.regexp_replace(html, r"(?is)<table[ >].*?</table>", "")
        first, rest = F.get(values, F.lit(0)), F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
        tagged = lambda x, name: F.rlike(F.lower(x), F.concat(F.lit("<"), F.lower(name), F.lit(r"[\s>/]")))
        groups = F.filter(F.split(html, r"(?=<[a-zA-Z])"), lambda x: F.lower(x).startswith(F.concat(F.lit("<"), F.lower(first))))
        leaf = rf"(?is)<(p|tr|li|div)(?:\s[^>]*)?>([^<]*(?:<(?!(?:{_BLOCKS})[\s>])[^<]*)*?)</\1>"
        named = F.expr(r"regexp_extract_all(coalesce(html, ''), concat('(?is)<', values[0], '(?:\\s[^>]*)?>(.*?)</', values[0], '>'), 1)")
        rules |= {
            "row": F.exists(rows, lambda r: (F.size(r) == F.size(values)) & same(r, values)),
            "rowContains": F.exists(rows, ordered),
            "tableRows": F.exists(_inner(html, "table"), lambda t: F.size(_inner(t, "tr")) >= first.try_cast("int")),
            "flowParagraph": F.exists(_inner(flow, "p"), lambda x: in_sequence(plain_text(x), values)),
            "group": (F.size(groups) > 0) & F.exists(named, lambda x: in_sequence(plain_text(x), rest)),
            "labelValue": F.exists(F.regexp_extract_all(html, F.lit(leaf), 2), lambda x: in_sequence(plain_text(x), values)),
            "mediaCaption": F.exists(_inner(html, "figure"), lambda x: tagged(x, first) & in_sequence(plain_text(x), rest)),
        }
    passed = reduce(lambda w, k: w.when(kind == k, rules[k]), rules, F.when(F.lit(False), F.lit(False))).otherwise(F.lit(False))
    passed = F.coalesce(passed & F.col("text").isNotNull(), F.lit(False))
    return met.withColumn("passed", passed).withColumn("blocks", F.col("verified") & ~F.col("passed"))
