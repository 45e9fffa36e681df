"""The pdf source: parts of files, conditions that reach it, streams and their logs, web options."""

import json
import os
import re
import urllib.request

import pytest

from pagewright.plans import write
from pagewright.schema import PAGES
from pagewright.sources import datasource, pdf


def a_file(name: str, pages: int, pad: int = 0) -> bytes:
    w = write.Writer()
    w.shared += b"/Resources<</Font<</F1 %d 0 R>>>>" % w.font()
    w.pages([write.stream(write.show(40, 700, 10, write.literal(f"{name} {n}")) + b" " * pad) for n in range(1, pages + 1)], fan=8)
    return w.packed()


@pytest.fixture
def schema(spark):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(PAGES)


def rows(reader, parts):
    out = []
    for p in parts:
        out += [(r[1], r[5][0][1] if r[5] else r[9][0]) for r in reader.read(p)]
    return sorted(out, key=str)


def test_parts_need_no_open_file(tmp_path, schema, monkeypatch):
    big = tmp_path / "big.pdf"
    big.write_bytes(a_file("big", 40, 20_000))
    for k in range(5):
        (tmp_path / f"s{k}.pdf").write_bytes(a_file(f"s{k}", 2))
    (tmp_path / "bad.pdf").write_bytes(b"broken")
    opened = []
    true = datasource.FileSource
    monkeypatch.setattr(datasource, "FileSource", lambda p: opened.append(p) or true(p))
    reader = datasource.PdfReader({"path": str(tmp_path), "partitionBytes": "100000"}, schema)
    parts = reader.partitions()
    assert not opened and len(parts) == 9 + 1  # 821 kB in nine parts, the small files in one
    want = [(n, f"big {n}") for n in range(1, 41)] + [(n, f"s{k} {n}") for k in range(5) for n in (1, 2)] + [(None, "INVALID_PDF")]
    assert rows(reader, parts) == sorted(want, key=str)
    few = datasource.PdfReader({"path": str(tmp_path), "partitionBytes": "100000", "pages": "3-4"}, schema)
    assert rows(few, few.partitions()) == sorted([(3, "big 3"), (4, "big 4"), (None, "INVALID_PDF")], key=str)


class Counting(datasource.FileSource):
    total = 0

    def read(self, offset, length):
        Counting.total += length
        return super().read(offset, length)


def test_conditions_reach_the_reader(tmp_path, schema, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, StringEndsWith

    (tmp_path / "a.pdf").write_bytes(a_file("a", 900, 20_000))
    (tmp_path / "b.pdf").write_bytes(a_file("b", 3))
    assert (tmp_path / "a.pdf").stat().st_size > 18_000_000
    monkeypatch.setattr(datasource, "FileSource", Counting)

    def read(*conditions):
        Counting.total = 0
        reader = datasource.PdfReader({"path": str(tmp_path), "pushDown": "true"}, schema)
        assert list(reader.pushFilters(list(conditions))) == list(conditions)  # Spark still applies them
        return rows(reader, reader.partitions())

    assert read(EqualTo(("page",), 7), StringEndsWith(("doc_id",), "a.pdf")) == [(7, "a 7")]
    assert Counting.total < 256 << 10
    assert read(EqualTo(("page",), 700)) == [(700, "a 700")] and Counting.total < 256 << 10
    assert read(GreaterThan(("page",), 897), IsNotNull(("page",))) == [(898, "a 898"), (899, "a 899"), (900, "a 900")] and Counting.total < 512 << 10
    assert read(In(("doc_id",), (str(tmp_path / "b.pdf"), "x")), LessThanOrEqual(("page",), 2)) == [(1, "b 1"), (2, "b 2")] and Counting.total < 10_000
    assert read(EqualTo(("page",), 2), EqualTo(("page",), 3)) == [] and Counting.total == 0


def test_conditions_through_spark(spark, tmp_path):
    datasource.register(spark)
    for k in range(3):
        (tmp_path / f"f{k}.pdf").write_bytes(a_file(f"f{k}", 6))
    (tmp_path / "g.pdf").write_bytes(b"broken")
    own = lambda c: datasource.pages_where(spark, str(tmp_path), c)
    got = own("page >= 3 and page < 5 and doc_id like '%f1.pdf'").selectExpr("page", "spans[0].text t").collect()
    assert sorted(map(tuple, got)) == [(3, "f1 3"), (4, "f1 4")]
    assert own("page = 3 or doc_id like '%f0.pdf'").count() == 8
    assert own("error is not null").count() == 1
    assert own("page in (2, 5)").count() == 6
    assert own("page = 3").unionAll(own("page = 4")).count() == 6
    df = spark.read.format("pdf").options(path=str(tmp_path)).load()  # one load for several queries
    assert [df.where(c).count() for c in ("page = 3", "page = 3 or doc_id like '%f0.pdf'", "true")] == [3, 8, 19]
    assert df.where("page = 3").unionAll(df.where("page = 4")).count() == 6


def caught(spark, folder, tmp_path, name, **options):
    """Rows of one run of a stream over what is there."""
    df = spark.readStream.format("pdf").options(path=str(folder), **options).load().selectExpr("page", "spans[0].text as text", "error.code")
    q = df.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-check")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return sorted((r.page or 0, r.text or r.code) for r in spark.read.schema("page int, text string, code string").parquet(str(tmp_path / f"{name}-out")).collect())


@pytest.mark.parametrize("logged", [True, False])
def test_streams_take_every_file_once(spark, tmp_path, logged):
    datasource.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    options = {"log": str(tmp_path / "log")} if logged else {}
    for k in (5, 6):
        (folder / f"f{k}.pdf").write_bytes(a_file(f"f{k}", 2))
    want = [(n, f"f{k} {n}") for n in (1, 2) for k in (5, 6)]
    assert caught(spark, folder, tmp_path, "s", **options) == sorted(want)
    # a late file whose name sorts before all others, one with an old time, one that was written anew
    (folder / "a1.pdf").write_bytes(a_file("a1", 1))
    (folder / "z1.pdf").write_bytes(a_file("z1", 1))
    newest = max(os.stat(p).st_mtime for p in folder.iterdir())
    os.utime(folder / "z1.pdf", (newest - 3600, newest - 3600))
    (folder / "f6.pdf").write_bytes(a_file("g6", 1, 50))
    (folder / "bad.pdf").write_bytes(b"broken")
    want += [(1, "a1 1"), (1, "z1 1"), (1, "g6 1"), (0, "INVALID_PDF")]
    assert caught(spark, folder, tmp_path, "s", **options) == sorted(want)
    assert caught(spark, folder, tmp_path, "s", **options) == sorted(want)  # nothing new


def test_offsets_of_streams(tmp_path, schema):
    folder, log = tmp_path / "in", str(tmp_path / "log")
    folder.mkdir()
    for k in range(5):
        (folder / f"f{k}.pdf").write_bytes(a_file(f"f{k}", 1))
        os.utime(folder / f"f{k}.pdf", (1e9 - k, 1e9 - k))  # the last name is the oldest
    options = {"path": str(folder), "maxFilesPerTrigger": "2"}
    names = lambda parts: sorted(os.path.basename(p)[:2] for x in parts for p in x.paths)
    for more in ({}, {"log": log}):
        stream = datasource.PdfStream(options | more, schema)
        at, got = stream.initialOffset(), []
        for _ in range(4):
            to = json.loads(json.dumps(stream.latestOffset()))
            got.append(names(stream.partitions(at, to)))
            at = to
        assert got == [["f3", "f4"], ["f1", "f2"], ["f0"], []]
    again = datasource.PdfStream(options | {"log": log}, schema)  # a restart
    assert again.latestOffset() == {"batch": 3} and names(again.partitions({"batch": 1}, {"batch": 2})) == ["f1", "f2"]
    (folder / "a.pdf").write_bytes(b"x")
    assert again.latestOffset() == {"batch": 4} and names(again.partitions({"batch": 3}, {"batch": 4})) == ["a."]
    old = datasource.PdfStream({"path": str(folder), "maxFileAge": "1"}, schema)
    assert [os.path.basename(p) for p in old.latestOffset()["files"]] == ["a.pdf"]  # the others are years older


def from_json(path, options):
    """A source of one's own for the test below."""
    return pdf.MemorySource(a_file(json.loads(path)["name"], int(options["pagesof"])))


def test_a_source_of_ones_own(schema):
    reader = datasource.PdfReader({"path": '{"name": "x"}\n{"name": "y"}', "source": f"{__name__}:from_json", "pagesOf": "2"}, schema)
    assert rows(reader, reader.partitions()) == [(1, "x 1"), (1, "y 1"), (2, "x 2"), (2, "y 2")]


@pytest.mark.parametrize("ranges", [True, False])
def test_web_options(schema, monkeypatch, ranges):
    import email.message
    import io

    data, asked = a_file("net", 2), []

    def opener(request, timeout=None):
        asked.append((dict(request.header_items()), timeout))
        low, high = map(int, re.findall(r"\d+", request.get_header("Range")))
        out = io.BytesIO(data[low : high + 1] if ranges else data)
        out.headers, out.status = email.message.Message(), 206 if ranges else 200
        out.headers["Content-Range"] = f"bytes {low}-{high}/{len(data)}"
        out.headers["Content-Length"] = str(len(data))
        return out

    monkeypatch.setattr(urllib.request, "urlopen", opener)
    monkeypatch.setattr(datasource.HttpSource.__init__, "__defaults__", (None, True, opener, None))
    options = {"path": "http://x/y.pdf", "headers": '{"X-Key": "k"}', "timeout": "3", "full": "false"}
    reader = datasource.PdfReader(options, schema)
    got = rows(reader, reader.partitions())
    assert got == ([(1, "net 1"), (2, "net 2")] if ranges else [(None, "UNSUPPORTED_FEATURE")])
    assert all(h.get("X-key") == "k" and t == 3.0 for h, t in asked)
