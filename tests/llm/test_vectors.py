"""Clustering and codes of vectors, and fingerprints, against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash

from pagewright.llm import centroids, simhash, vector_codes
from pagewright.llm._common import Shelf, slices
from pagewright.llm.vectors import root_down, root_up

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster int, code string, x int, r int"


def vectors(n=300, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.2, (7, 64)).astype(np.float32)
    rows = [(i, (middle[i % 7] + rng.normal(0, 0.05, 64)).astype(np.float32).tolist(), None if i % 9 == 0 else i % 4) for i in range(n)]
    rows += [(n, rows[3][1], 1), (n + 1, rows[3][1], 1), (5, rows[5][1], 2), (None, rows[8][1], None)]
    bad = [None] * 3 + [[0.5] * 63 + [None], [0.5] * 63 + [math.nan], [math.inf] + [0.0] * 63, [0.5] * 32, []]
    return rows, [(1000 + i, v, 1) for i, v in enumerate(bad)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2, 3) for r in rows], SCHEMA).repartition(3)


def whole(v):
    return [math.floor(256 * y) for y in v]


def lloyd(points, start, rounds):
    books, placed = [list(c) for c in start], []
    for step in range(rounds + 1):
        placed = [min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), j) for j, c in enumerate(books)) for p in points]
        if step < rounds:
            for j in range(len(books)):
                own = [p for p, (_, k) in zip(points, placed, strict=True) if k == j]
                if own:
                    books[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return books, placed


def test_roots_are_exact():
    n = np.array([0, 1, 2, 3, 4, 8, 9, 2**52 - 1, 2**52, 94906265**2 - 1, 94906265**2, 2**61 - 1], np.int64)
    assert root_down(n).tolist() == [math.isqrt(x) for x in n.tolist()]
    assert root_up(n).tolist() == [math.isqrt(x) + (math.isqrt(x) ** 2 < x) for x in n.tolist()]


@pytest.mark.parametrize("k", [1, 13, 40])
def test_clusters_equal_brute_force(spark, k):
    rows, bad = vectors()
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), whole(r[1])))
    books, placed = lloyd([whole(r[1]) for r in rows], [whole(r[1]) for r in order[:k]], 5)
    got, final = centroids.cluster(frame(spark, rows + bad), k=k)
    want = sorted(((r[0], j, d) for r, (d, j) in zip(rows, placed, strict=True)), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert final.tolist() == books
    told = centroids.digests(got, final).collect()
    assert {r.inertia for r in told} == {sum(d for d, _ in placed)}
    for r in told:
        assert r.cluster_inertia == sum(d for d, j in placed if j == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, books[r.cluster])).encode()).hexdigest()


def test_screening_prunes_and_never_the_nearest():
    rng = np.random.default_rng(5)
    c = np.floor(rng.normal(0, 300, (40, 64))).astype(np.int64) * np.repeat(rng.integers(0, 3, (40, 16)), 4, axis=1)
    x = c[rng.integers(0, 40, 2000)] + rng.integers(-20, 21, (2000, 64))
    x[:40], x[40:80] = c, (c + c[::-1]) // 2  # ties of equal and of middle places
    norms = root_up(np.add.reduceat(x * x, np.arange(0, 64, 4), axis=1))
    screen = centroids.Screen(c, 4)
    exact = ((x[:, None] - c) ** 2).sum(axis=2)
    assert (screen.bounds(x, norms) <= exact).all()
    found, d = screen.nearest(x, norms)
    assert (found == exact.argmin(axis=1)).all() and (d == exact.min(axis=1)).all()
    assert screen.exact < 0.2 * exact.size


def test_clusters_of_odd_tables(spark):
    rows, bad = vectors(9)
    assert centroids.digests(*centroids.cluster(frame(spark, []))).collect() == []
    assert centroids.digests(*centroids.cluster(frame(spark, bad))).collect() == []
    got, final = centroids.cluster(frame(spark, rows[:4]), k=40)
    assert len(final) == 4 and {(r.cluster, r.distance) for r in got.collect()} == {(j, 0) for j in range(4)}
    with pytest.raises(Exception, match="not below"):
        centroids.cluster(frame(spark, [(1, [3e5] + [0.0] * 63, 1)]))[0].collect()


def brute_codes(rows, entries, rounds, parts=16):
    kept = sorted(rows, key=lambda r: (r[0] is None, r[0], whole(r[1])))
    n = 64 // parts
    codes, errors, final = ["" for _ in rows], [0] * len(rows), []
    for p in range(parts):
        books, placed = lloyd([whole(r[1])[n * p : n * p + n] for r in rows], [whole(r[1])[n * p : n * p + n] for r in kept[:entries]], rounds)
        final += [x for c in books for x in c]
        for i, (d, j) in enumerate(placed):
            codes[i] += f"{j:02x}"
            errors[i] += d
    return codes, errors, hashlib.sha256(",".join(map(str, final)).encode()).hexdigest()


@pytest.mark.parametrize(("entries", "rounds"), [(64, 2), (5, 4), (1, 1)])
def test_codes_equal_brute_force(spark, entries, rounds):
    rows, bad = vectors()
    codes, errors, told = brute_codes(rows, entries, rounds)
    got = vector_codes.digests(*vector_codes.encode(frame(spark, rows + bad), entries=entries, rounds=rounds)).collect()
    by_label = {}
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    want = [(r[0], c, e, by_label[r[2]], told) for r, c, e in zip(rows, codes, errors, strict=True)]
    want += [(i, None, None, by_label[1], told) for i, v, _ in bad if v in ([0.5] * 32, [])]  # another width: no parts
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_bounds_hold_and_prune_as_entries_move():
    rng = np.random.default_rng(7)
    middle = rng.integers(-400, 400, (16, 64, 4))
    v = np.arange(1500) % 64
    x = middle[:, v].transpose(1, 0, 2) + rng.integers(-9, 10, (1500, 16, 4))
    books = x[:64].transpose(1, 0, 2).copy()
    code, upper, lower = vector_codes.Codebooks(books).begin(x)
    for step in range(4):
        before = books
        books = books + rng.integers(-6, 7, books.shape) * (step != 2)  # one round without movement
        now = vector_codes.Codebooks(books)
        asked = now.follow(x, code, upper, lower, now.movement(before))
        square = ((x[:, :, None] - books[None]) ** 2).sum(axis=3)
        assert (code == square.argmin(axis=2)).all()
        held = np.take_along_axis(square, code[:, :, None], axis=2)[:, :, 0]
        assert (upper**2 >= 16 * held).all() and (lower**2 <= 16 * square).all()
        assert asked < 0.1 * square.size


def test_codes_of_odd_tables(spark):
    _, bad = vectors(9)
    assert vector_codes.digests(*vector_codes.encode(frame(spark, []))).collect() == []
    assert [r.code for r in vector_codes.digests(*vector_codes.encode(frame(spark, bad))).collect()] == [None, None]
    far = [(i, [float(s * 2e5)] * 64, 1) for i, s in enumerate([1, -1, 1])]  # beyond 16 bits of bounds
    codes, errors, told = brute_codes(far, 64, 2)
    got = vector_codes.digests(*vector_codes.encode(frame(spark, far))).collect()
    assert sorted((r.vec_id, r.code, r.error, r.codebooks_sha256) for r in got) == [(i, c, e, told) for i, (c, e) in enumerate(zip(codes, errors, strict=True))]


# ---------------------------------------------------------------- SimHash
def brute_fingerprint(text, k=3):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_links(fps, radius):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    some = sorted(fps)
    for i, a in enumerate(some):
        for b in some[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(b)] = find(a)
    return {f: find(f) for f in fps}


def texts(seed=2):
    rng = random.Random(seed)
    words = [f"wörd{i}" for i in range(300)]
    out = [None, "", " \n\t", "One", "one two", "ONE two  three", "one two\nthree", "\x0b\x0ca\rb c", "x" * 9000, " ".join(rng.choices(words, k=20_000)), "ÉCOLE é É"]
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([4, 40, 900]))
        out.append(" ".join(base))
        for _ in range(5):
            other = list(base)
            other[rng.randrange(len(other))] = rng.choice(words)
            out.append("\t".join(other) + " ")
    return out


def test_fingerprints_of_slices():
    import pyarrow as pa

    some = texts()
    got = np.concatenate([simhash.fingerprints_of(p, 3, rows=1000) for p in slices(pa.array([t or "" for t in some]), lower=True, limit=5000)])
    assert got.tolist() == [brute_fingerprint(t) for t in some]


@pytest.mark.parametrize(("radius", "most"), [(2, 1024), (2, 2), (1, 3), (3, 1024)])
def test_near_documents_equal_all_pairs(spark, radius, most):
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts())] + [(None, "one two three"), (None, "nothing like it"), (5, "another five"), (5, "one two")]
    docs = spark.createDataFrame([(i, t, 1, 2, "n") for i, t in rows], "doc_id bigint, text string, fp int, mask int, key string").repartition(3)
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_links(set(fps), radius)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    want = [(i, f"{f:016x}", least.get(roots[f])) for (i, _), f in zip(rows, fps, strict=True)]
    got = simhash.near_duplicates(docs, radius=radius, most=most).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(docs.limit(0), radius=radius).collect() == []


def planted(n=400, seed=3):
    """Fingerprints around few middles, so that buckets are crowded."""
    rng = random.Random(seed)
    middles = [rng.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        f = rng.choice(middles)
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 5, 9])):
            f ^= 1 << b
        out.add(f)
    return sorted(out | {rng.getrandbits(64) for _ in range(n)})


@pytest.mark.parametrize("most", [1024, 20, 1])
def test_crowded_buckets_lose_no_link(spark, most):
    fps = planted()
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint").repartition(5)
    edges = simhash.near_fingerprints(nodes, Shelf(spark, "t"), most=most).collect()
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for r in edges:
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        root[find(a)] = find(b)
    want = brute_links(fps, 2)
    groups = lambda m: sorted(sorted(f for f in fps if m[f] == g) for g in set(m.values()))
    assert groups({f: find(f) for f in fps}) == groups(want)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_lanes_within_the_radius(radius):
    fps = np.array(planted(150), np.uint64)
    until = np.sort(np.random.default_rng(1).integers(0, len(fps), len(fps)))
    until = np.maximum(until, np.arange(len(fps)) + 1)
    root = simhash.linked(fps, until, radius, blocks=37)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i + 1, until[i]) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius]
    want = np.arange(len(fps))
    for _ in range(len(fps)):
        for i, j in pairs:
            want[i] = want[j] = min(want[i], want[j])
    assert root.tolist() == want.tolist()


def test_masks_hold_two_blocks_and_end_small():
    some = {0}
    for _ in range(simhash.LEVELS):
        some = {c for m in some for c in simhash.finer(m, 2)}
    assert {m.bit_count() for m in some} == {56}
    for a in range(0, 64, 7):
        for b in range(64):
            apart = 1 << a | 1 << b
            assert any(not m & apart for m in simhash.finer(0, 2))
