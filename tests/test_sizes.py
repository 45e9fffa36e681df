"""Larger tables than the smallest: what grew faster than its input, or came out otherwise."""

import time

import pytest
from pyspark.sql import functions as F

from pagewright import queries
from pagewright.operators import structure


def test_rects_at_one_place_meet_once(spark):
    rect = lambda n, w: spark.range(n).select(F.col("id").alias("n"), F.lit(1).alias("k"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(w).alias("x1"), F.lit(w).alias("y1"))
    inner, outer = rect(200_000, 1.0).withColumnRenamed("n", "inner_id"), rect(200_000, 2.0).withColumnRenamed("n", "outer_id")
    began = time.time()
    found = structure.smallest_container(inner, outer, ["k"]).agg(F.count(F.lit(1)), F.max("outer_id")).first()
    assert tuple(found) == (200_000, 0)
    assert time.time() - began < 60  # pairs of rows would be 40,000,000,000


def _equals_sql(spark, name, folder, tables):
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, str(folder)).select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_ruled_tables_of_many_rows(spark, tmp_path):
    supplier = spark.range(1, 902).select(F.col("id").alias("s_suppkey"), F.format_string("Supplier#%09d", "id").alias("s_name"), F.when(F.col("id") < 900, 3).otherwise(4).alias("s_nationkey"))
    supplier.write.parquet(str(tmp_path / "supplier.parquet"))
    _equals_sql(spark, "pdf_ruled_tables", tmp_path, ["supplier"])


@pytest.mark.parametrize("name", ["pdf_encodings", "wrapped_paragraphs", "superscript_lines", "scripts_in_order"])
def test_small_tables_are_dealt_over_tasks(spark, name):
    """A page or file a row is more work than its bytes say: one task a shuffle partition."""
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_files_leave_as_they_are_made():
    import pyarrow as pa

    from pagewright.plans import write

    rows = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(11)]), pa.array(range(11))], ["doc_id", "k"])
    made = list(write.made_of([rows], lambda k: bytes([k]) * (3 << 20)))
    assert [len(b) for b in made] == [2, 2, 2, 2, 2, 1]
    assert [(x, y[0]) for b in made for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True)] == [(str(k), k) for k in range(11)]


def test_parts_of_a_file_are_bounded():
    from pagewright.sources import datasource

    assert len(datasource.planned([("a.pdf", 40 << 20)], 20_000)) == datasource.PARTS
    assert len(datasource.planned([("a.pdf", 100_000)], 20_000)) == 5


def test_rows_of_a_stream_are_made_once(spark, tmp_path):
    """By all tasks, however many batches they arrive in."""
    from pagewright.streaming import run

    def noted(batches):
        import os
        import uuid

        for batch in batches:
            open(os.path.join(str(tmp_path), f"{uuid.uuid4().hex}.task"), "w").close()
            yield batch

    rows = spark.range(0, 40, 1, 4).mapInArrow(noted, "id bigint")
    out = run.by_batches(rows, "id", [10, 20], lambda stream: stream, f"file://{tmp_path}/flow")
    assert sorted(r["id"] for r in out.collect()) == list(range(40))
    assert len(list(tmp_path.glob("*.task"))) == 4


def test_counts_of_kept_rows_on_several_executors():
    """Executors that ask for the same kept rows at once each make them: an observation counted those twice."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = """
import duckdb, tempfile
from pyspark.sql import SparkSession
from pagewright.file_queries import QUERIES, SQL
sf = "/root/testdata/sf0.01"
base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
spark = SparkSession.builder.master("local-cluster[3,2,2048]").config("spark.sql.shuffle.partitions", "6").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", base).config("spark.local.dir", base).getOrCreate()
got = tuple(QUERIES["observed_documents"](spark, sf).first())
want = duckdb.sql(SQL["observed_documents"].replace("FROM lineitem", f"FROM read_parquet('{sf}/lineitem.parquet')")).fetchall()[0]
assert got == want, (got, want)
print("equal")
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=170)
    assert "equal" in done.stdout, done.stderr[-2000:]


def test_words_of_pairs_are_counted_by_pair(spark):
    """One shuffle, of texts by pair: no task of the reader holds the words of its whole split, and parts grow with the splits."""
    diffs = queries.QUERIES["document_diffs"](spark, "/root/testdata/sf0.001")
    plan = diffs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert diffs.rdd.getNumPartitions() >= queries.PARTS_A_SPLIT


def test_rules_of_equal_drawings_are_told_once(monkeypatch):
    """Ruled pages of one layout have the same strokes; each page told its rules anew, with the square of their number."""
    from pagewright.operators import page

    told, across = [], page._across
    monkeypatch.setattr(page, "_across", lambda *a: told.append(a) or across(*a))
    page._rules_kept.cache_clear()

    def ruled(k, upright):
        spans = [page.Span(x, 740.0 - 15 * r, 20.0, 10.0, 3 * r + c, f"{k}.{r}.{c}", 10.0, "Body") for r in range(4) for c, x in enumerate((40.0, 100.0, 130.0))]
        paths = [{"d": f"M 30 {752 - 15 * r} L 400 {752 - 15 * r}", "stroke": "#000000", "stroke_opacity": 1.0} for r in range(5)]
        paths += [{"d": f"M {x} 600 L {x} 752", "stroke": "#000000", "stroke_opacity": 1.0} for x in ((30, 90, 400) if upright else ())]
        return page.structure(612.0, 792.0, spans, [], paths, page.Options(), 0, "cells")[1]

    fill = {"points": [{"x": 0.0, "y": 10.0}, {"x": 1.0, "y": 10.0}, {"x": 1.0, "y": 11.0}]}
    for k in range(20):
        for upright in (False, True):
            (table,) = ruled(k, upright)
            assert table.reason == "horizontal-row-rules" and table.columns == ([30.0, 90.0] if upright else [40.0, 100.0, 130.0])
            assert [(c.row, c.column, c.text) for c in table.cells][:2] == [(0, 0, f"{k}.0.0"), (0, 1, f"{k}.0.1 {k}.0.2" if upright else f"{k}.0.1")]
            table.columns.append(0.0)  # a table's columns are its own
    assert len(told) == 2
    assert page.horizontal_rules(612.0, 792.0, [fill], []) == []
