"""Line dedup (7, native): winnowing over line hashes; later repeated runs of lines go.

A document's lines are its text cut at newlines; lines of white space alone are never counted
and always stay. A run is ``min_lines`` consecutive counted lines. A line is removed when a run
that covers it also starts earlier (smaller doc_id, or same document and earlier line).

1. *Select.* Of every ``min_lines`` consecutive lines the one of least hash (the leftmost of
   equals) is selected, once however many windows select it. Two texts that share a run select
   the same line in it, so selected lines are guaranteed fingerprints of every run. A row holds a
   fingerprint, its place, and the lines around it that its windows reach.
2. *Join positions.* Places of one fingerprint meet by it; a fingerprint that stands once in the
   corpus has no match and goes, with its context.
3. *Extend.* From the places that are left, matches are extended to both sides: every window
   around the fingerprint that selected it is compared by a 128-bit hash of its lines, and the
   earliest of equal ones stays. Overlapping later windows are one longer removed run.

Rows that share a doc_id count as one document (a null id comes first); rows are told apart by a
hash of their text. Null text has no lines and stays null. Documents with fewer lines than a run
lose nothing. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Shelf

FIRST = -(1 << 63)


def _lines() -> Column:
    """Counted lines as array<struct<i int, h bigint, g bigint>>: place, and two hashes."""
    placed = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.struct(
            F.when(F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) == "", F.lit(-1)).otherwise(i).alias("i"),
            F.xxhash64(x).alias("h"),
            F.xxhash64(F.lit(1), x).alias("g"),
        ),
    )
    return F.filter(placed, lambda s: s["i"] >= 0)


def winnowed(docs: DataFrame, w: int) -> DataFrame:
    """A row for each fingerprint: id, mark, fp and around, the lines that its windows reach."""
    lined = docs.where(F.col("text").contains("\n") | F.lit(w == 1)).select(
        F.coalesce(F.col("doc_id"), F.lit(FIRST)).alias("id"), F.xxhash64("text").alias("mark"), _lines().alias("l")
    )
    lined = lined.where(F.size("l") >= w)

    def selected(first: Column) -> Column:
        """The place of the least hash of the window that begins at ``first``."""
        best, place = F.get("l", first)["h"], first
        for k in range(1, w):
            now = F.get("l", first + k)["h"]
            place, best = F.when(now < best, first + k).otherwise(place), F.least(best, now)
        return place

    # in steps, so that each array is made once
    windows = lined.withColumn("n", F.size("l") - w).withColumn("at", F.transform(F.sequence(F.lit(0), F.col("n")), selected))
    begins = F.filter(F.sequence(F.lit(0), F.col("n")), lambda i: (i == 0) | (F.get("at", i) != F.get("at", i - 1)))
    placed = windows.withColumn("first", begins)

    def row(i: Column, k: Column) -> Column:
        many = F.coalesce(F.get("first", k + 1), F.col("n") + 1) - i
        return F.struct(F.get("l", F.get("at", i))["h"].alias("fp"), F.slice("l", i + 1, many + (w - 1)).alias("around"))

    return placed.select("id", "mark", F.explode(F.transform("first", row)).alias("x")).select("id", "mark", "x.fp", "x.around")


def extended(places: DataFrame, w: int) -> DataFrame:
    """Every window around the fingerprints of ``places``: id, mark, at, lines, run_h, run_g."""
    windows = F.transform(F.sequence(F.lit(1), F.size("around") - (w - 1)), lambda i: F.slice("around", i, w))
    return places.select("id", "mark", F.explode(windows).alias("w")).select(
        "id", "mark", F.get("w.i", F.lit(0)).alias("at"), F.col("w.i").alias("lines"), F.xxhash64("w.h").alias("run_h"), F.xxhash64("w.g").alias("run_g")
    )


def repeated_runs(seen: DataFrame, w: int) -> DataFrame:
    """id, mark, lines of every run of ``w`` lines around the fingerprints ``seen`` that also starts earlier."""
    shared = seen.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp")
    near = extended(seen.join(shared.hint("merge"), "fp", "left_semi"), w)
    first = near.groupBy("run_h", "run_g").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").drop("n")
    return near.join(first.hint("merge"), ["run_h", "run_g"]).where(F.struct("id", "at") > F.col("first")).select("id", "mark", "lines")


def dedup_lines(docs: DataFrame, *, min_lines: int = 2, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with text (what is left), n_lines and n_removed: a row for each input row.

    The joins are partitioned at every size: what meets in them grows with the corpus.
    """
    shelf = Shelf(docs.sparkSession, "lines")
    seen = shelf.put(winnowed(docs.select("doc_id", "text"), min_lines), "fingerprints")
    found = repeated_runs(seen, min_lines).groupBy("id", "mark").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lost"))
    lost = shelf.put(found, "lost")
    shelf.drop(seen)
    joined = docs.select(
        *[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)],
        F.coalesce(F.col("doc_id"), F.lit(FIRST)).alias("id"), F.xxhash64("text").alias("mark"), "text",
    ).join(lost.hint("merge"), ["id", "mark"], "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("lost", i)), "\n")
    breaks = F.length("text") - F.length(F.translate("text", "\n", ""))
    return joined.select(
        *[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)],
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_removed"),
    )


SQL = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
e AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM s
), c AS (
  SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k,
         lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS y
  FROM e WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), d AS (
  SELECT doc_id, k FROM c WHERE y IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY doc_id, k) > 1
), gone AS (
  SELECT DISTINCT c.doc_id, c.i FROM c JOIN d ON c.doc_id = d.doc_id AND c.k IN (d.k, d.k + 1)
), left_over AS (
  SELECT e.doc_id, string_agg(x, chr(10) ORDER BY e.i) FILTER (WHERE gone.i IS NULL) AS t,
         count(*) AS n_lines, count(gone.i) AS n_removed
  FROM e LEFT JOIN gone ON e.doc_id = gone.doc_id AND e.i = gone.i GROUP BY e.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN left_over o ON d.doc_id = o.doc_id
"""
