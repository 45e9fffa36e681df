"""Aggregates and joins over positioned rows: medians, dominant sizes, covered widths, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upper_median(c: str | Column) -> Column:
    """The upper middle value, never interpolated; null for no values."""
    held = F.array_sort(F.collect_list(c))
    return F.get(held, (F.size(held) / 2).cast("int"))


def dominant_size(df: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Most frequent half-point size of each group; ties go to the smaller."""
    counted = df.groupBy(*keys, (F.floor(2 * F.col(size) + 0.5) / 2).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.max_by("bucket", F.struct("n", -F.col("bucket"))).alias("body_size"))


def continued_tables(tables: DataFrame, *, width: float, share: float = 0.04) -> DataFrame:
    """``tables`` (doc_id, page, table_seq, columns; optionally caption) with logical_table: a table goes on
    from the one before it if both have the same number of columns, each starts within ``share``,
    and it has no caption or the same. Rows are the surviving blocks: one that is no table (null columns) stands between."""
    w = W.partitionBy("doc_id").orderBy("page", "table_seq")
    before = F.lag("columns").over(w)
    near = F.forall(F.zip_with("columns", before, lambda a, b: F.abs(a - b) <= width * share), lambda x: x)
    goes_on = F.coalesce((F.size("columns") >= 2) & (F.size("columns") == F.size(before)) & near, F.lit(False))
    if "caption" in tables.columns:
        goes_on &= F.col("caption").isNull() | F.col("caption").eqNullSafe(F.lag("caption").over(w))
    return tables.withColumn("new", (~goes_on).cast("int")).withColumn("logical_table", F.sum("new").over(w)).drop("new")


def covered_width(intervals: DataFrame, keys: list[str], bridge: float = 2.0) -> DataFrame:
    """Length of the union of [left, right] intervals of each group; gaps up to ``bridge`` count."""
    w = W.partitionBy(*keys).orderBy("left", "right")
    reach = F.max("right").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce((F.col("left") > F.col("reach") + bridge).cast("int"), F.lit(1))
    islands = intervals.withColumn("reach", reach).withColumn("island", F.sum(new).over(w))
    spans = islands.groupBy(*keys, "island").agg(F.min("left").alias("a"), F.max("right").alias("b"))
    return spans.groupBy(*keys).agg(F.sum(F.col("b") - F.col("a")).alias("covered"))


def smallest_container(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """Each inner rect (inner_id, x0, y0, x1, y1) with the least outer rect that holds it, of equals the first by id.

    Places meet, not rows: pairs are made of the distinct rects of each group, however many rows stand at one."""
    rect = ["x0", "y0", "x1", "y1"]
    area = (F.col("ox1") - F.col("ox0")) * (F.col("oy1") - F.col("oy0"))
    at = [F.col(c).alias(f"o{c}") for c in rect]
    o = outer.groupBy(*keys, *at).agg(F.min(F.struct("outer_id")).alias("o"))
    held = inner.select(*keys, *rect).distinct().join(o, keys).where("ox0 <= x0 and oy0 <= y0 and ox1 >= x1 and oy1 >= y1")
    least = held.groupBy(*keys, *rect).agg(F.min(F.struct(area.alias("area"), F.col("o.outer_id").alias("outer_id"))).alias("least"))
    return inner.join(least, [*keys, *rect]).groupBy(*keys, "inner_id").agg(F.min("least")["outer_id"].alias("outer_id"))


def weighted_mode(df: DataFrame, keys: list[str], value: str, weight: Column, order: str) -> DataFrame:
    """The value of most weight in each group (characters of a colour, say); of equals the first seen."""
    summed = df.groupBy(*keys, value).agg(F.sum(weight).alias("w"), F.min(order).alias("seen"))
    return summed.groupBy(*keys).agg(F.max_by(value, F.struct("w", -F.col("seen"))).alias(value))


def union_box(df: DataFrame, keys: list[str]) -> DataFrame:
    """x, y, width, height of the least box around each group's (x, y, width, height)."""
    right, top = F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))
    return df.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("width"), (top - F.min("y")).alias("height"))


def rotated(x: Column, y: Column, w: Column, h: Column, rotate: Column, page_width: Column, page_height: Column) -> Column:
    """A box in display space: the page turned clockwise by 0, 90, 180 or 270 degrees."""
    box = lambda a, b, c, d: F.struct(a.alias("x"), b.alias("y"), c.alias("width"), d.alias("height"))
    return (
        F.when(rotate == 90, box(y, page_width - x - w, h, w))
        .when(rotate == 180, box(page_width - x - w, page_height - y - h, w, h))
        .when(rotate == 270, box(page_height - y - h, x, h, w))
        .otherwise(box(x, y, w, h))
    )


def linked_spans(spans: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """``spans`` (x, y, width, height, size) with href: of the page's regions that hold a span's middle and
    both its ends, within max(0.5, 0.35 * size), the one of the last annotation. Page-local: the join
    is on the page's keys, and a page has few regions."""
    near = F.greatest(F.lit(0.5), F.col("size") * 0.35)
    middle = F.col("y") + F.col("height") / 2
    inside = (
        (F.col("lx") - near <= F.col("x")) & (F.col("x") + F.col("width") <= F.col("lx") + F.col("lw") + near)
        & middle.between(F.col("ly"), F.col("ly") + F.col("lh")) & (F.col("x") + F.col("width") / 2).between(F.col("lx"), F.col("lx") + F.col("lw"))
    )
    held = spans.join(links, keys).where(inside).groupBy(*keys, "seq").agg(F.max_by("href", "annot_seq").alias("href"))
    return spans.join(held, [*keys, "seq"], "left")
