"""``spark.read.format("pdf")``: pages by random access to files and web addresses.

Options:

- ``path``: a file, a folder or a glob on storage that every executor mounts, or http(s) addresses,
  several parted by a line break. Files in a store that only Spark reads go through ``pdf.read_pages``.
- ``pages``: ``first-last``, from 1.
- ``pushDown`` (``true``): conditions on ``page`` and ``doc_id`` (=, in, <, >, prefixes, suffixes) narrow what is
  read in the same way: other files are not opened, other pages not read. Off by default, as Spark 4.1 keeps a
  loaded frame's last pushed conditions for all queries of that frame, also for those that push none: with it,
  load anew for each condition, as ``pages_where`` does.
- ``partitionBytes`` (32 MiB): larger files are cut into as many partitions of their pages, ``PARTS`` at most, smaller ones
  share a partition. No file is opened for that: a partition is "part i of n", and an executor finds the
  pages. ``pagesPerPartition`` asks for ranges of so many pages; then the driver reads the page counts.
- ``headers`` (a JSON object), ``timeout`` (seconds) and ``full`` (``false``: no whole bodies where ranges are
  not answered): of web requests.
- ``source``: ``module:name`` of a function (path, options) that gives an object with ``size`` and
  ``read(offset, length)``; paths are then its own business and not looked for.
- ``mode`` and the parser's limits.

``readStream`` takes files as they appear, each as it is seen by name, time and size; see ``PdfStream``.
"""

from __future__ import annotations

import glob
import importlib
import json
import os
import urllib.request
import warnings
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
    StringEndsWith, StringStartsWith,
)

from ..schema import PAGES
from .pdf import BATCH_WEIGHT, Document, Limits, PdfError, batch_of, error_of, rows_of

PARTITION_BYTES = 32 << 20
#: A part reads its file's cross references and the page tree's root, so parts of one file must not grow with it.
PARTS = 32
#: A web address is not asked for its size before it is read.
UNKNOWN = -1


class FileSource:
    """Ranges of a file; a read goes on until it is filled."""

    def __init__(self, path: str):
        self.path, self.size = path, os.path.getsize(path)

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ValueError("a range outside the file")
        out = bytearray()
        with open(self.path, "rb") as f:
            f.seek(offset)
            while len(out) < length:
                part = f.read(length - len(out))
                if not part:
                    raise EOFError("the file ended early")
                out += part
        return bytes(out)


class HttpSource:
    """Ranges of a web address.

    A first request for one byte tells the size and whether ranges are answered. A strong ETag is
    sent along as If-Range, a weak one never. A server that answers 200 with the whole body is read up to
    the range asked for, if ``full`` allows it, with one warning a source.
    """

    def __init__(self, url: str, headers: dict[str, str] | None = None, full: bool = True, opener=urllib.request.urlopen, timeout: float | None = None):
        self.url, self.headers, self.full, self.opener = url, headers or {}, full, opener
        self.more = {"timeout": timeout} if timeout else {}
        self.tag, self.warned = None, False
        with self._ask("bytes=0-0") as r:
            tag = r.headers.get("ETag")
            self.tag = tag if tag and not tag.startswith("W/") else None
            if r.status == 206:
                total = (r.headers.get("Content-Range") or "").rpartition("/")[2]
                if not total.isdigit():
                    raise PdfError("INVALID_PDF", "the server did not tell the size")
                self.size = int(total)
            else:
                self._whole()
                length = r.headers.get("Content-Length")
                self.size = int(length) if length else sum(len(part) for part in iter(lambda: r.read(1 << 16), b""))

    def _ask(self, span: str):
        extra = {"Range": span} | ({"If-Range": self.tag} if self.tag else {})
        return self.opener(urllib.request.Request(self.url, headers=self.headers | extra), **self.more)

    def _whole(self) -> None:
        if not self.full:
            raise PdfError("UNSUPPORTED_FEATURE", "the server does not answer ranges")
        if not self.warned:
            warnings.warn(f"{self.url} does not answer ranges; whole bodies are read", stacklevel=3)
            self.warned = True

    def read(self, offset: int, length: int) -> bytes:
        if not length:
            return b""
        with self._ask(f"bytes={offset}-{offset + length - 1}") as r:
            if r.status == 206:
                out = r.read()
            else:
                self._whole()
                left = offset
                while left and (part := r.read(min(left, 1 << 16))):
                    left -= len(part)
                out = r.read(length)
        if len(out) != length:
            raise EOFError("the answer ended early")
        return out


def open_source(path: str, options: dict | None = None):
    """The random-access source of a path, as the options say."""
    options = options or {}
    if named := options.get("source"):
        module, _, name = named.partition(":")
        return getattr(importlib.import_module(module), name)(path, dict(options))
    if not path.startswith(("http://", "https://")):
        return FileSource(path)
    headers = json.loads(options.get("headers") or "{}")
    timeout = float(options["timeout"]) if options.get("timeout") else None
    return HttpSource(path, headers, str(options.get("full", "true")).lower() != "false", timeout=timeout)


def found(path: str, source: str | None = None) -> list[str]:
    """Files at ``path`` in the order of their names; with a ``source`` of one's own its lines as they are."""
    out = []
    for p in filter(None, (x.strip() for x in path.split("\n"))):
        if source or p.startswith(("http://", "https://")):
            out.append(p)
            continue
        p = p.removeprefix("file://")
        if os.path.isdir(p):
            out += sorted(glob.glob(os.path.join(p, "**", "*.pdf"), recursive=True))
        else:
            out += sorted(glob.glob(p))
    return out


def told(path: str) -> tuple[int, int]:
    """(time, size) of a file, in nanoseconds and bytes; of what is no file here (0, ``UNKNOWN``)."""
    try:
        s = os.stat(path)
    except OSError:
        return 0, UNKNOWN
    return s.st_mtime_ns, s.st_size


class Pages(InputPartition):
    """Files of a partition, or part ``i`` of ``n`` of one file's pages, within ``first`` and ``last`` (not included)."""

    def __init__(self, paths: list[str], part: tuple[int, int] = (0, 1), first: int = 0, last: int | None = None):
        self.paths, self.part, self.first, self.last = paths, part, first, last


def planned(sizes: list[tuple[str, int]], step: int, first: int = 0, last: int | None = None) -> list[Pages]:
    """Partitions of about ``step`` bytes; of a few pages of a file there is one."""
    out, some, held = [], [], 0
    for path, size in sizes:
        if size > step and (last is None or last - first > 64):
            n = min(PARTS, -(-size // step))
            out += [Pages([path], (i, n), first, last) for i in range(n)]
            continue
        cost = step if size == UNKNOWN else min(size, step)
        if some and held + cost > step:
            out.append(Pages(some, (0, 1), first, last))
            some, held = [], 0
        some.append(path)
        held += cost
    return out + ([Pages(some, (0, 1), first, last)] if some else [])


def _values(row: dict, schema) -> tuple:
    """A row in the order of ``schema``; nested dictionaries become tuples by its names."""
    from pyspark.sql.types import ArrayType, StructType

    def shaped(value, kind):
        if value is None:
            return None
        if isinstance(kind, StructType):
            return tuple(shaped(value.get(f.name), f.dataType) for f in kind)
        if isinstance(kind, ArrayType):
            return [shaped(v, kind.elementType) for v in value]
        return value

    return tuple(shaped(row.get(f.name), f.dataType) for f in schema)


class _Reading:
    """What readers of files and of streams share."""

    def __init__(self, options: dict, schema):
        self.options, self.limits, self.schema = dict(options), Limits.of(options), schema
        self.own = low = {k.lower(): v for k, v in options.items()}
        self.mode = low.get("mode", "PERMISSIVE").upper()
        self.bytes = int(low.get("partitionbytes", PARTITION_BYTES))
        if self.bytes < 1:
            raise ValueError("partitionBytes: one at least")

    def _found(self) -> list[str]:
        return found(self.own["path"], self.own.get("source"))

    def _range(self, source, partition: Pages) -> tuple[int, int | None]:
        """The pages of a partition; a file is asked for its count only if it is parted."""
        i, n = partition.part
        if n == 1:
            return partition.first, partition.last
        count = Document(source, self.limits).page_count()
        low, high = partition.first, count if partition.last is None else min(count, partition.last)
        return max(low, count * i // n), min(high, count * (i + 1) // n)

    def read(self, partition: Pages) -> Iterator[tuple]:
        return (_values(row, self.schema) for row in self.rows(partition))

    def batches(self, partition: Pages) -> Iterator:
        """The same as Arrow batches: a page's spans are told at once, not value by value."""
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, held, weight = to_arrow_schema(self.schema), [], 0
        for row in self.rows(partition):
            held.append(row)
            weight += len(row.get("spans") or ()) + 1
            if weight >= BATCH_WEIGHT:
                yield batch_of(held, schema, self.mode)
                held, weight = [], 0
        if held:
            yield batch_of(held, schema, self.mode)

    def rows(self, partition: Pages) -> Iterator[dict]:
        for path in partition.paths:
            try:
                source = open_source(path, self.own)
                first, last = self._range(source, partition)
            except Exception as e:  # noqa: BLE001  damaged input shows in many ways
                if self.mode == "FAILFAST":
                    raise
                if self.mode == "PERMISSIVE" and partition.part[0] == 0:  # a file's error is one row
                    yield {"doc_id": path, "error": error_of(e)}
                continue
            if last is None or first < last:
                yield from rows_of(path, source, self.limits, self.mode, first, last)


class PdfReader(_Reading, DataSourceReader):
    def __init__(self, options: dict, schema):
        super().__init__(options, schema)
        self.step = int(self.own.get("pagesperpartition", 0))
        low, _, high = self.own.get("pages", "").partition("-")
        self.first, self.last = (int(low) - 1 if low else 0), (int(high) if high else int(low) if low else None)
        if self.first < 0 or (self.last is not None and self.last <= self.first):
            raise ValueError("pages: first-last, from 1")
        self.pushes = str(self.own.get("pushdown", "false")).lower() == "true"
        #: conditions on doc_id, as (how, values)
        self.named: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        """Conditions on page narrow the range of pages, those on doc_id the files. All are left to Spark as well."""
        for f in filters if self.pushes else []:
            column = ".".join(f.attribute) if getattr(f, "attribute", None) else ""
            value = getattr(f, "value", None)
            if column == "page":
                values = f.value if isinstance(f, In) else (value,)
                values = [v for v in values if v is not None]
                if not values:
                    continue
                if isinstance(f, (EqualTo, In)):
                    self._narrow(min(values) - 1, max(values))
                elif isinstance(f, GreaterThan):
                    self._narrow(value, None)
                elif isinstance(f, GreaterThanOrEqual):
                    self._narrow(value - 1, None)
                elif isinstance(f, LessThan):
                    self._narrow(0, value - 1)
                elif isinstance(f, LessThanOrEqual):
                    self._narrow(0, value)
            elif column == "doc_id":
                if isinstance(f, (EqualTo, In)):
                    self.named.append(("in", tuple(f.value) if isinstance(f, In) else (value,)))
                elif isinstance(f, StringStartsWith):
                    self.named.append(("starts", (value,)))
                elif isinstance(f, StringEndsWith):
                    self.named.append(("ends", (value,)))
        return filters

    def _narrow(self, first: int, last: int | None) -> None:
        self.first = max(self.first, first)
        if last is not None:
            self.last = last if self.last is None else min(self.last, last)

    def _asked(self, path: str) -> bool:
        rules = {"in": lambda v: path in v, "starts": lambda v: path.startswith(v[0]), "ends": lambda v: path.endswith(v[0])}
        return all(rules[how](v) for how, v in self.named)

    def partitions(self) -> list[Pages]:
        """Parts of files by their sizes. Only ``pagesPerPartition`` opens files here: their tails and page trees' roots."""
        if self.last is not None and self.last <= self.first:
            return [Pages([])]
        paths = [p for p in self._found() if self._asked(p)]
        if not self.step:
            return planned([(p, told(p)[1]) for p in paths], self.bytes, self.first, self.last) or [Pages([])]
        out = []
        for path in paths:
            try:
                n = Document(open_source(path, self.own), self.limits).page_count()
            except Exception:  # noqa: BLE001  the error shows where the file is read
                out.append(Pages([path]))
                continue
            end = n if self.last is None else min(n, self.last)
            out += [Pages([path], (0, 1), k, min(k + self.step, end)) for k in range(self.first, end, self.step)]
        return out or [Pages([])]


class PdfStream(_Reading, DataSourceStreamReader):
    """Pages of files as they appear, parted as in batches; the driver lists names, times and sizes alone.

    With ``log``, a folder that belongs to one stream as its checkpoint does, each batch's files are
    written there before the batch runs, ``maxFilesPerTrigger`` at a time; a file is new if it was not
    seen with this name, time and size, whatever its name or time. Without it, an offset holds the files
    of the last ``maxFileAge`` (days, 7) before the newest: older ones are not read, and after a
    restart the first batch takes all that is new."""

    def __init__(self, options: dict, schema):
        super().__init__(options, schema)
        self.most = int(self.own.get("maxfilespertrigger", 0))
        self.age = int(float(self.own.get("maxfileage", 7)) * 86_400 * 10**9)
        self.log, self.last = self.own.get("log"), None
        if self.log:
            self.log = self.log.removeprefix("file://")
            os.makedirs(self.log, exist_ok=True)
            self.seen, self.batch = {}, 0
            while os.path.exists(self._entry(self.batch + 1)):
                self.batch += 1
                self.seen |= self._logged(self.batch)

    def _entry(self, n: int) -> str:
        return os.path.join(self.log, f"{n}.json")

    def _logged(self, n: int) -> dict:
        with open(self._entry(n)) as f:
            return {p: tuple(x) for p, x in json.load(f).items()}

    def _listed(self) -> dict[str, tuple[int, int]]:
        return {p: told(p) for p in self._found()}

    def initialOffset(self) -> dict:
        self.last = {}
        return {"batch": 0} if self.log else {"files": {}}

    def latestOffset(self) -> dict:
        now = self._listed()
        if self.log:
            new = sorted((x, p) for p, x in now.items() if self.seen.get(p) != x)
            new = {p: x for x, p in new[: self.most or None]}
            if new:
                part = f"{self._entry(self.batch + 1)}.{os.getpid()}"
                with open(part, "w") as f:
                    json.dump(new, f)
                os.replace(part, self._entry(self.batch + 1))
                self.batch += 1
                self.seen |= new
            return {"batch": self.batch}
        newest = max((t for t, _ in now.values()), default=0)
        held = {p: x for p, x in now.items() if x[0] >= newest - self.age}
        if self.most and self.last is not None:
            new = sorted((x, p) for p, x in held.items() if tuple(self.last.get(p, ())) != x)
            late = {p for _, p in new[self.most :]}
            held = {p: x for p, x in held.items() if p not in late}
        self.last = held
        return {"files": {p: list(x) for p, x in sorted(held.items())}}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        if self.log:
            new: dict[str, tuple[int, int]] = {}
            for n in range(start["batch"] + 1, end["batch"] + 1):
                new |= self._logged(n)
        else:
            new = {p: tuple(x) for p, x in end["files"].items() if start["files"].get(p) != x}
            self.last = {p: tuple(x) for p, x in end["files"].items()}
        return planned([(p, x[1]) for p, x in sorted(new.items())], self.bytes)


class BatchReader(PdfReader):
    read = _Reading.batches


class BatchStream(PdfStream):
    read = _Reading.batches


class PdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> PdfReader:
        return BatchReader(self.options, schema)

    def streamReader(self, schema) -> PdfStream:
        return BatchStream(self.options, schema)


def pages_where(spark: SparkSession, path: str, condition: str | Column, **options) -> DataFrame:
    """Pages at ``path`` that meet ``condition``, which reaches the reader: a load of its own."""
    register(spark)
    return spark.read.format("pdf").options(path=path, pushDown="true", **options).load().where(condition)


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("pdf")`` known to a session, and lets conditions reach it where ``pushDown`` asks for them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PdfSource)
