"""Vector code compression (12): product codes from codebooks trained by Elkan's variant of Lloyd.

*State.* A vector's row keeps, for each of its parts, the entry it has, an upper bound of the
distance to that, and one lower bound for each entry of the part's codebook. Rounds write it to
the shared folder and read it again, so a lost executor costs one round at most.
*Bounds.* Distances are held in quarters as integers: upper bounds rounded up, lower ones down
(16 bits, cut at 65,535, which is still a lower bound). When entries move, an upper bound grows by
its entry's movement (rounded up) and a lower one shrinks by its entry's.
*Pruning.* Entry j is skipped where the upper bound is strictly below j's lower bound, or strictly
below half the distance of the two entries; an entry that may tie is never skipped. What is left
gets its squared distance as an integer, and ties go to the lower index by those.
*Rounds.* Sums are taken from the stored codes: a row for each part and entry of a task, so that
the driver holds parts * entries rows, whatever the number of vectors.

Vectors that are null or hold a null, NaN or infinite component are left out. Vectors of another
width have no parts: they stay with null code and error and train nothing. With fewer vectors than
``entries`` a codebook has as many. An empty table gives an empty result. Rows of null vec_id come
last as first entries, equal vec_ids by their vectors; repeated rows are vectors of their own.
Components of 262,144 or more raise an error. Other columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Shelf, small_batches, tidy
from .vectors import fixed_point, is_finite, lists, matrix, moved, root_down, root_up

#: Bounds are in quarters: 16 times the square under the root.
_UNIT = 16
_TOP = 65_535
_STATE = "vec_id bigint, label int, x array<int>, code binary, upper binary, lower binary, exact bigint"


class Codebooks:
    """``entries`` of each part (parts, entries, length), and their distances to one another."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.parts, self.entries, self.length = books.shape
        away = books[:, :, None, :] - books[:, None, :, :]
        #: half the distance of two entries, rounded down; none to itself
        self.half = root_down(_UNIT * (away * away).sum(axis=3)) // 2

    def movement(self, before: np.ndarray) -> np.ndarray:
        """How far each entry has moved, rounded up."""
        away = self.books - before
        return root_up(_UNIT * (away * away).sum(axis=2))

    def exact(self, x: np.ndarray, v: np.ndarray, p: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Squared distances of parts p of vectors v to entries j."""
        away = x[v, p] - self.books[p, j]
        return (away * away).sum(axis=-1)

    def begin(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, upper, lower) of vectors without a state: all distances."""
        square = np.empty((len(x), self.parts, self.entries), np.int64)
        for p in range(self.parts):
            away = x[:, p, None, :] - self.books[p]
            square[:, p] = (away * away).sum(axis=2)
        code = square.argmin(axis=2)  # the first of equals
        best = np.take_along_axis(square, code[:, :, None], axis=2)[:, :, 0]
        return code, root_up(_UNIT * best), np.minimum(root_down(_UNIT * square), _TOP)

    def follow(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, movement: np.ndarray) -> int:
        """Brings a state to the moved entries, in place; the number of exact distances."""
        part = np.arange(self.parts)
        upper += movement[part, code]
        np.maximum(lower - movement, 0, out=lower)

        def open_(v, p):
            """Entries that bounds leave open, one row for each of the parts (v, p)."""
            has, u = code[v, p], upper[v, p][:, None]
            left = (u >= lower[v, p]) & (u >= self.half[p, has])
            left[np.arange(len(v)), has] = False
            return left

        v, p = (a.ravel() for a in np.indices(code.shape))
        some = open_(v, p).any(axis=1)
        v, p = v[some], p[some]
        best = self.exact(x, v, p, code[v, p])  # tight now, and asked again
        upper[v, p] = root_up(_UNIT * best)
        lower[v, p, code[v, p]] = np.minimum(root_down(_UNIT * best), _TOP)
        left = open_(v, p)
        row, j = np.nonzero(left)
        d = self.exact(x, v[row], p[row], j)
        lower[v[row], p[row], j] = np.minimum(root_down(_UNIT * d), _TOP)
        # least (distance, index) of those asked and the present entry
        all_d = np.full(left.shape, np.iinfo(np.int64).max)
        all_d[row, j] = d
        all_d[np.arange(len(v)), code[v, p]] = best
        wins = all_d.argmin(axis=1)
        code[v, p] = wins
        upper[v, p] = root_up(_UNIT * all_d[np.arange(len(v)), wins])
        return len(v) + len(row)


def _binary(rows: np.ndarray, kind):
    """Rows of a matrix as an Arrow column of bytes."""
    import pyarrow as pa

    flat = np.ascontiguousarray(rows.reshape(len(rows), -1), kind)
    step = flat.shape[1] * flat.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * step
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])


def _numbers(column, kind, shape: tuple[int, ...]) -> np.ndarray:
    """An Arrow column of bytes as longs of a shape by row."""
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), *shape).astype(np.int64)


def _round(state: DataFrame, books: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """The state after one assignment; ``before``: the entries that the state's bounds are of."""
    parts, entries, length = books.shape

    def run(batches):
        import pyarrow as pa

        now = Codebooks(books)
        shift = None if before is None else now.movement(before)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                x = matrix(some.column("x"), parts * length).reshape(-1, parts, length)
                if shift is None:
                    code, upper, lower = now.begin(x)
                    exact = code.size * entries
                else:
                    code = _numbers(some.column("code"), np.uint8, (parts,))
                    upper = _numbers(some.column("upper"), np.int64, (parts,))
                    lower = _numbers(some.column("lower"), np.uint16, (parts, entries))
                    exact = now.follow(x, code, upper, lower, shift)
                share = np.zeros(len(x), np.int64)
                share[:1] = exact
                yield pa.RecordBatch.from_arrays(
                    [some.column("vec_id"), some.column("label"), some.column("x"), _binary(code, np.uint8), _binary(upper, np.int64), _binary(lower, np.uint16), pa.array(share)],
                    ["vec_id", "label", "x", "code", "upper", "lower", "exact"],
                )

    return state.mapInArrow(tidy(run), _STATE)


def _updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries at the floor of their parts' means."""
    parts, entries, length = books.shape

    def run(batches):
        import pyarrow as pa

        sums, counts = np.zeros((parts * entries, length), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), parts * length).reshape(-1, length)
            at = (_numbers(batch.column(1), np.uint8, (parts,)) + np.arange(parts) * entries).ravel()
            np.add.at(sums, at, x)
            counts += np.bincount(at, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), lists(sums[some], np.int64)], ["at", "n", "sums"])

    partial = state.select("x", "code").mapInArrow(tidy(run), "at bigint, n bigint, sums array<bigint>")
    totals = partial.groupBy("at").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(length)]).alias("sums"))
    sums, counts = np.zeros((parts * entries, length), np.int64), np.zeros(parts * entries, np.int64)
    for r in totals.collect():  # parts * entries rows at most
        sums[r["at"]], counts[r["at"]] = r.sums, r.n
    return moved(sums.reshape(books.shape), counts.reshape(parts, entries), books)


def encode(
    vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, width: int = 64, vector: str = "embedding", label: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code string, error; the codebooks): ``rounds`` rounds from the vectors of least vec_id."""
    if width % parts or not 0 < entries <= 256:
        raise ValueError("parts divide the width, and an index takes one byte")
    spark = vectors.sparkSession
    small_batches(spark)
    shelf = Shelf(spark, "codes")
    kept = vectors.where(is_finite(vector))
    fits = kept.where(F.size(vector) == width).select("vec_id", F.col(label).cast("int").alias("label"), fixed_point(vector).alias("x"))
    other = kept.where(F.size(vector) != width).select("vec_id", F.col(label).cast("int").alias("label"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    first = fits.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    length = width // parts
    if not first:
        return other, np.zeros((parts, 0, length), np.int64)
    books = np.array([r.x for r in first], np.int64).reshape(-1, parts, length).transpose(1, 0, 2)
    state, before = fits, None
    for step in range(rounds + 1):
        new = shelf.put(_round(state, books, before), f"state{step}")
        if step:
            shelf.drop(state)
        state, before = new, books
        if step < rounds:
            books = _updated(state, books)

    def run(batches):
        import pyarrow as pa

        last = Codebooks(books)
        for batch in batches:
            x = matrix(batch.column(2), width).reshape(-1, parts, length)
            code = _numbers(batch.column(3), np.uint8, (parts,))
            v, p = (a.ravel() for a in np.indices(code.shape))
            error = last.exact(x, v, p, code.ravel()).reshape(code.shape).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(error)], ["vec_id", "label", "code", "error"])

    told = state.select("vec_id", "label", "x", "code").mapInArrow(tidy(run), "vec_id bigint, label int, code binary, error bigint")
    done = told.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
    return done.unionByName(other), books


def digests(coded: DataFrame, books: np.ndarray, salts: int = 8) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256.

    Labels' sums meet the rows by label and a salt, so a label that many rows have is no one task's."""
    told = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    key = [F.coalesce("label", F.lit(0)).alias("l"), F.col("label").isNull().alias("none")]
    by = coded.groupBy(*key).agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = coded.select("*", *key, F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int").alias("salt"))
    return rows.join(by, ["l", "none", "salt"]).select("vec_id", "code", "error", "label_error", F.lit(told).alias("codebooks_sha256"))


def sql(parts: int = 16, entries: int = 64, rounds: int = 2, width: int = 64) -> str:
    """All distances, round by round."""
    n = width // parts
    cut = ", ".join(f"x[{n} * p + {i + 1}] AS x{i}" for i in range(n))
    away = " + ".join(f"(x{i} - e{i}) * (x{i} - e{i})" for i in range(n))
    steps = [
        f"""v AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER () AS r, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = len(embedding)
), s AS MATERIALIZED (SELECT r, p, {cut} FROM v, (SELECT unnest(range({parts})) AS p) WHERE len(x) = {width}
), c0 AS MATERIALIZED (
  SELECT p, k, {", ".join(f"x{i} AS e{i}" for i in range(n))} FROM s JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS k FROM v WHERE len(x) = {width} ORDER BY k LIMIT {entries}) USING (r)
)"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT s.r, s.p, {', '.join(f'any_value(x{q}) AS x{q}' for q in range(n))}, min(({away}) * {entries} + k) AS b FROM s JOIN c{i} ON c{i}.p = s.p GROUP BY s.r, s.p)"
        )
        if i < rounds:
            floor = ", ".join(f"(s{q} - ((s{q} % n) + n) % n) // n AS m{q}" for q in range(n))
            steps.append(f"""m{i} AS (SELECT p, k, {floor} FROM (
  SELECT p, b % {entries} AS k, count(*) AS n, {", ".join(f"sum(x{q})::BIGINT AS s{q}" for q in range(n))} FROM a{i} GROUP BY 1, 2)
), c{i + 1} AS MATERIALIZED (
  SELECT c.p, c.k, {", ".join(f"coalesce(m{q}, e{q}) AS e{q}" for q in range(n))} FROM c{i} c LEFT JOIN m{i} m ON m.p = c.p AND m.k = c.k
)""")
    flat = ", ".join(f"e{q}" for q in range(n))
    return (
        "WITH "
        + ",\n".join(steps)
        + f""", f AS (
  SELECT r, string_agg(printf('%02x', b % {entries}), '' ORDER BY p) AS code, sum(b // {entries})::BIGINT AS error FROM a{rounds} GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string([{flat}], ','), ',' ORDER BY p, k)) FROM c{rounds}) AS codebooks_sha256
FROM v LEFT JOIN f USING (r)"""
    )
