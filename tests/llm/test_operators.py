"""The corpus operators against brute force on small tables with nulls, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest

from pagewright.llm import _common, decontaminate, encoding, exact_dedup, langid, line_dedup, lm, minhash, sharding, substring_dedup, token_counts

WORDS = [f"w{i}" for i in range(60)]
SCHEMA = "doc_id bigint, text string, lang string, node string, id int, bucket string, at string"


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.choice([0, 1, 2, 5, 19, 20, 21, 60, 120]))) for _ in range(n // 2)]
    texts = list(base)
    for _ in range(n - len(base)):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            if words:
                words[rng.randrange(len(words))] = rng.choice(WORDS).upper()
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    cut = "\n".join(base[-1].split())
    texts += [None, "", " \n\t ", "ça été ñandú", cut, cut, "x" * 5000, "a\nb\nc\n\nd", "z\nb\nc\n \nd"]
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1, "y", "z") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = split((t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    return out


def brute_components(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                one, two = sorted((find(a), find(b)))
                root[two] = one
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_minhash_equals_all_pairs(spark, docs, rows, k):
    from pyspark.sql import functions as F

    lowered = docs.withColumn("text", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(lowered, shingle=k).collect()}
    sets = sets_of(rows, k)
    roots = brute_components(sets)
    assert got == {i: (len(sets[i]), roots[i], roots[i] == i) for i in sets}


def test_minhash_odd_tables(spark, empty):
    assert minhash.near_duplicates(empty).collect() == []
    text = " ".join(WORDS)
    odd = spark.createDataFrame([(None, text), (None, text), (5, text), (5, text), (7, text + " more"), (7, "other words here")], "doc_id bigint, text string")
    got = sorted(minhash.near_duplicates(odd, shingle=2).select("doc_id", "component_id", "kept").collect(), key=str)
    assert len(got) == 6
    assert {(r.component_id, r.kept) for r in got if r.doc_id == 7} == {(5, False)}
    assert all(r.kept for r in got if r.doc_id is None)


@pytest.mark.parametrize("text", ["one", "one two", "one two three", "one two three four"])
def test_minhash_of_a_slice_shorter_than_a_shingle(spark, text):
    alone = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = minhash.near_duplicates(alone, shingle=5).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, True)]


def test_language_of_held_out_rows(spark):
    rng = random.Random(3)
    sounds = {"aa": ["ba", "be", "bi", "lo", "la"], "bb": ["tsch", "ung", "ver", "heit"], "cc": ["ñe", "ción", "que", "ar"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(sounds))
        rows.append((i, " ".join("".join(rng.choices(sounds[lang], k=3)) for _ in range(20)), lang))
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !", "aa"), (1003, "bala", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(langid.training_rows(docs))
    got = {r.doc_id: r for r in langid.predict(docs.select("doc_id", "text"), model).collect()}
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.97 * len(held)
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_laws_sum_to_one(spark, empty):
    buf = np.frombuffer(b"abracadabra abrakadabra", np.uint8)
    g, n = np.unique(langid.grams(buf, np.array([0, len(buf)]), 3), return_counts=True)
    tree = langid.Tree.grown(g, n.astype(float), 3)
    for context in (b"abr", b"xyz", b"aka", b"\0\0a"):
        keys = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert abs((2.0 ** tree.logs(keys, 4)).sum() - 1) < 1e-6
    assert langid.predict(empty, langid.train(empty)).collect() == []


def test_grams_do_not_cross_texts():
    buf, offsets = np.frombuffer(b"abcXY", np.uint8), np.array([0, 3, 3, 4, 5])
    assert [int(x) for x in langid.grams(buf, offsets, 2)] == [0x61, 0x6162, 0x616263, 0x58, 0x59]


def brute_substrings(rows, window):
    seen, gone = {}, defaultdict(set)
    for i, t in sorted(rows):
        w = split(t)
        for k in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[k : k + window]), (i, k)) != (i, k):
                gone[i].update(range(k, k + window))
    return gone


@pytest.mark.parametrize(("window", "phrase"), [(20, 6), (4, 2)])
def test_substrings(spark, docs, rows, window, phrase):
    gone = brute_substrings(rows, window)
    got = substring_dedup.dedup_substrings(docs, window=window, phrase=phrase).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        w = split(texts[r.doc_id])
        assert (r.n_words, r.n_removed) == (len(w), len(gone[r.doc_id]))
        assert r.text == " ".join(x for k, x in enumerate(w) if k not in gone[r.doc_id])
        covered = set()
        for f in r.factors:  # each has its words at its source, no shorter than a window, and starts later
            source = split(texts[f.source])
            assert w[f.start : f.end] == source[f.source_start : f.source_start + f.end - f.start] and f.end - f.start >= window
            assert (f.source, f.source_start) < (r.doc_id, f.start)
            covered |= set(range(f.start, f.end))
        assert covered == gone[r.doc_id]


def test_factors_are_as_long_as_they_can_be(spark):
    rng = random.Random(12)
    base = [f"u{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join(["own"] + base[40:290] + ["words"])), (3, " ".join(base[10:60] + base[200:260]))]
    got = {r.doc_id: [tuple(f) for f in r.factors] for r in substring_dedup.dedup_substrings(frame(spark, rows)).collect()}
    assert got == {1: [], 2: [(1, 251, 1, 40)], 3: [(0, 50, 1, 10), (50, 110, 1, 200)]}


def test_substrings_odd_tables(spark, empty):
    assert substring_dedup.dedup_substrings(empty).collect() == []
    t = " ".join(WORDS)
    odd = spark.createDataFrame([(None, t), (3, t), (3, t), (4, "ha " * 100)], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.dedup_substrings(odd).collect())
    assert got == [("3", 60), ("3", 60), ("4", 99), ("None", 0)]


def test_language_model(spark, docs, rows):
    got = {r.doc_id: r for r in lm.score(lm.with_fold(docs), head=20, states=3).collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    tokens = {i: [w.lower() for w in split(t)] + [None] for i, t in rows}
    c = Counter(w for i, x in tokens.items() if not fold[i] for w in x)
    n, v = sum(c.values()), len(c)
    for i, x in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold[i], len(x), sum(c[w] > 0 for w in x), n)
        assert r.base_score == pytest.approx(sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), abs=1e-6)
        assert r.score < 0


def test_forward_is_exact_and_training_helps():
    rng = np.random.default_rng(1)
    model = lm.HMM(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), rng.dirichlet(np.ones(4), 2).T)
    seqs = [rng.integers(0, 4, k).astype(np.uint16) for k in (1, 5, 3, 7)]
    for s, got in zip(seqs, lm.forward_log10(model, seqs), strict=True):
        total = 0.0
        for path in np.ndindex(*[2] * len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            total += p
        assert got == pytest.approx(log10(total), abs=1e-9)
    opened, moved, emitted = lm.expected_counts(model, seqs, np.ones(4, bool))
    assert opened.sum() == pytest.approx(4, abs=1e-3)
    assert moved.sum() == pytest.approx(sum(map(len, seqs)) - 4, abs=1e-3)
    assert emitted.sum() == pytest.approx(sum(map(len, seqs)), abs=1e-3)
    better = lm.HMM(opened / opened.sum(), moved / moved.sum(axis=1, keepdims=True), emitted / emitted.sum(axis=0))
    assert lm.forward_log10(better, seqs).sum() > lm.forward_log10(model, seqs).sum()


def test_language_model_without_rows(spark, empty):
    assert lm.score(lm.with_fold(empty)).collect() == []


def test_shards(spark, docs, rows, empty):
    got = sharding.shard_rows_evenly(docs, 7, min_cells=5).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    texts = dict(rows)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    assert sharding.shard_rows_evenly(empty).collect() == []
    again = sharding.shard_rows_evenly(docs.repartition(2), 7, min_cells=5).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_hypergeometric_law():
    rng = np.random.default_rng(0)
    draws = Counter(sharding.hypergeometric(rng, 5, 7, 4) for _ in range(20000))
    from math import comb

    for k in range(5):
        assert draws[k] / 20000 == pytest.approx(comb(5, k) * comb(7, 4 - k) / comb(12, 4), abs=0.015)
    big = sharding.communication_matrix([10**9, 2 * 10**9, 5], [10**9 + 1, 2 * 10**9 + 4], 1)
    assert big.sum(axis=1).tolist() == [10**9, 2 * 10**9, 5]
    assert big.sum(axis=0).tolist() == [10**9 + 1, 2 * 10**9 + 4]


def test_decontamination(spark, docs, rows):
    texts = dict(rows)
    source = max((t for t in texts.values() if t), key=lambda t: len(split(t)))
    items = [(1, " ".join(split(source)[3:20]).upper()), (2, " ".join(split(source)[3:20])), (10, "w1 w2"), (11, None), (12, " ... "), (13, "ça-été")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")

    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    for block_words in (1_000_000, 10):
        got = {r.doc_id: r for r in decontaminate.find_hits(docs, bench, block_words=block_words).collect()}
        for i, t in rows:
            w, hit, ids = cut(t), set(), set()
            for item, text in items:
                x = cut(text)
                for k in range(max(1, len(x) - 12)) if x else ():
                    win = x[k : k + 13]
                    for s in range(len(w) - len(win) + 1):
                        if w[s : s + len(win)] == win:
                            hit.update(range(s, s + len(win)))
                            ids.add(item)
            r = got[i]
            assert (r.n_words, sum(x.end - x.start for x in r.spans), r.item_ids) == (len(w), len(hit), sorted(ids))
    assert decontaminate.find_hits(docs, bench.limit(0)).where("size(spans) > 0").count() == 0


def test_benchmark_items_without_an_id_count(spark, tmp_path):
    import duckdb

    from pagewright.llm.queries import op6_decontaminate

    w = [f"q{i}" for i in range(40)]
    docs = [(1, " ".join(w[:20])), (2, " ".join(w[5:25])), (3, " ".join(w[20:])), (4, "no hit"), (5, None)]
    items = [(None, " ".join(w[:15])), (None, " ".join(w[6:19])), (7, " ".join(w[5:19])), (-3, " ".join(w[22:36]))]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = sorted(tuple(r) for r in op6_decontaminate(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(decontaminate.SQL).fetchall())
    assert [r[2:4] for r in got] == [(19, 2), (14, 2), (14, 1), (0, 0), (0, 0)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block_words in (1_000_000, 14):
        found = decontaminate.find_hits(spark.createDataFrame(docs, "doc_id bigint, text string"), bench, block_words=block_words)
        assert {r.doc_id: r.item_ids for r in found.collect()} == {1: [7, None], 2: [7, None], 3: [-3], 4: [], 5: []}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b y c"), (2, "c b a"), (3, "a b"), (4, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.at) for r in decontaminate.proximity_matches(docs, "A b, c", 3).collect())
    assert got == [(2, 0)]
    assert [r.doc_id for r in decontaminate.proximity_matches(docs, "a b", 4).orderBy("doc_id").collect()] == [1, 2, 3]


def test_lines(spark, docs, rows, empty):
    seen, gone = {}, defaultdict(set)
    for i, t in sorted(rows):
        lines = (t or "").split("\n")
        held = [k for k, x in enumerate(lines) if split(x)]
        for k in range(len(held) - 1):
            run = (lines[held[k]], lines[held[k + 1]])
            if seen.setdefault(run, (i, k)) != (i, k):
                gone[i].update(held[k : k + 2])
    for r in line_dedup.dedup_lines(docs).collect():
        t = dict(rows)[r.doc_id]
        assert r.n_removed == len(gone[r.doc_id])
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[r.doc_id])
        assert r.text == want
    assert any(gone.values())
    assert line_dedup.dedup_lines(empty).collect() == []


@pytest.mark.parametrize("w", [1, 2, 3, 5])
def test_lines_of_any_run_length(spark, w):
    rng = random.Random(w)
    texts = {i: "\n".join(rng.choice(["a", "b", "c", "d", " ", "e f"]) for _ in range(rng.choice([1, 3, 8, 30]))) for i in range(40)}
    seen, gone = {}, defaultdict(set)
    for i, t in texts.items():
        lines = t.split("\n")
        held = [k for k, x in enumerate(lines) if split(x)]
        for k in range(len(held) - w + 1):
            run = tuple(lines[j] for j in held[k : k + w])
            if seen.setdefault(run, (i, k)) != (i, k):
                gone[i].update(held[k : k + w])
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, list(texts.items())), min_lines=w).collect()}
    assert got == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in texts.items()}


def test_fingerprints_are_thinned(spark):
    text = "\n".join(f"line {k}" for k in range(400))
    for w, most in ((2, 0.75), (8, 0.35)):
        n = line_dedup.winnowed(frame(spark, [(1, text)]).select("doc_id", "text"), w).count()
        assert 0 < n <= most * 400
    # without its fingerprints a repeated run is not found: every removal comes through them
    docs = frame(spark, [(1, text), (2, text)]).select("doc_id", "text")
    seen = line_dedup.winnowed(docs, 2)
    assert line_dedup.repeated_runs(seen, 2).count() == 399
    assert line_dedup.repeated_runs(seen.where("id = 1 or fp % 2 = 0"), 2).count() < 399


def test_token_counts_and_encoding_equal_the_library(spark, docs, rows, empty):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=encoding.default_model_path())
    odd = [*rows, (900, "漢字 \U0001f600 a  b   c\n\n1,234.5 ..."), (901, "x" * 300 + " y" + " " * 40)]
    docs = frame(spark, odd)
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()}
    coded = encoding.encode(docs).cache()
    back = {r.doc_id: r.text for r in encoding.decode(coded).collect()}
    for r in coded.collect():
        t = dict(odd)[r.doc_id] or ""
        want = own.encode(t)
        assert r.token_ids == want
        assert counts[r.doc_id] == r.n_tokens == len(want)
        assert r.round_trip and back[r.doc_id] == t
    assert encoding.encode(empty).collect() == [] and token_counts.count_tokens(empty).collect() == []


def test_exact(spark, docs, rows, empty):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    for kwargs in ({}, {"bucket_rows": 3, "max_depth": 4}):
        got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs, **kwargs).collect()}
        for norm, members in groups.items():
            keep = min(members)[1]
            for _, i in members:
                r = got[i]
                assert (r.keep_id, r.group_size, r.kept) == (keep, len(members), i == keep)
                assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()
        if kwargs:
            assert max(r.bucket_depth for r in got.values()) > 1
    assert exact_dedup.exact_duplicates(empty).collect() == []


def test_exact_looks_up_through_the_directory(spark, docs, rows, monkeypatch):
    true = exact_dedup.directory
    want = {tuple(r) for r in exact_dedup.exact_duplicates(docs, bucket_rows=3, max_depth=4).drop("bucket", "bucket_depth").collect()}
    asked = exact_dedup.exact_duplicates(docs, bucket_rows=3, max_depth=4)
    joins = [x for x in asked._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "text_sha256" in x]
    assert len(joins) == 1 and all(x in joins[0] for x in ("bucket", "key"))
    assert {tuple(r) for r in asked.drop("bucket", "bucket_depth").collect()} == want and len(want) == len(rows)
    # buckets are the directory's: where it numbers them anew, documents follow it
    monkeypatch.setattr(exact_dedup, "directory", lambda *a: true(*a).selectExpr("cell", "depth", "bucket + 1000 AS bucket"))
    moved = exact_dedup.exact_duplicates(docs, bucket_rows=3, max_depth=4)
    assert {tuple(r) for r in moved.drop("bucket", "bucket_depth").collect()} == want
    assert min(r.bucket for r in moved.collect()) >= 1000


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    text = lambda: "\n".join(" ".join(rng.choices(WORDS, k=12)) for _ in range(6))
    rows = [(i, text(), "en", "s", 0) for i in range(40)]
    near = rows[0][1].split(" ")
    near[5] = "changed"
    rows += [(50, " ".join(near), "en", "s", 0), (51, None, None, "s", 0), (52, "1234 5678", None, "s", 0)]
    item = " ".join(rng.choices(WORDS, k=20))
    rows += [(60, item + " and a little more", "en", "s", 0), (61, "\n".join(rows[1][1].split("\n")[:3]) + "\nfresh line of words here now", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not {51, 52, 60} & set(got)
    assert set(range(1, 40)) <= set(got) and got[0].text == rows[0][1]
    assert got[61].text == "fresh line of words here now"
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got.values())


def varied(n=300, words=60, seed=4):
    """Variants of one text at mutual similarities on both sides of 0.8, and the text itself."""
    rng = random.Random(seed)
    base = [f"v{i}" for i in range(words)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        w = list(base)
        for k in rng.sample(range(words), rng.choice([1, 2, 3, 4, 5, 6, 8])):
            w[k] = rng.choice([f"x{rng.randrange(5)}", f"y{i}"])
        rows.append((i, " ".join(w)))
    return rows


def test_minhash_of_a_large_group_makes_few_pairs(spark, monkeypatch):
    rows = varied()
    pairs = []
    true = minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda p, *a: pairs.append(p.count()) or true(p, *a))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), shingle=2).collect()}
    assert got == brute_components(sets_of(rows, 2))
    assert len(set(got.values())) > 10
    assert pairs[0] <= 3 * len(rows) and sum(pairs) < len(rows) ** 2 / 10


def in_one_bucket(spark, rows, k, monkeypatch=None):
    """Components that parity bitmaps and confirmation find where all texts share one bucket, and how many pairs were confirmed."""
    from pagewright.llm._common import Shelf

    shelf = Shelf(spark, "test")
    sets = shelf.put(minhash.full_sets(frame(spark, rows).select("doc_id", "text"), k).where("n > 0"), "sets")
    members = sets.selectExpr("7L as bucket", "node", f"{len(rows)}L as n")
    pairs, true = [], minhash._confirmed
    if monkeypatch:
        monkeypatch.setattr(minhash, "_confirmed", lambda p, *a: pairs.append(p.count()) or true(p, *a))
    roots = minhash._decided(members, sets, spark.createDataFrame([], "node bigint, root bigint"), shelf, 80)
    got = {i: i for i, _ in rows} | {r.node: r.root for r in roots.collect()}
    return got, sum(pairs)


@pytest.mark.parametrize("block", [2048, 16])
def test_parity_alone_finds_every_component(spark, monkeypatch, block):
    from pagewright.llm import parity

    monkeypatch.setattr(parity.in_blocks, "__defaults__", (block,))
    rows = varied(120)
    got, _ = in_one_bucket(spark, rows, 2)
    want = brute_components(sets_of(rows, 2))
    assert got == want and 1 < len(set(want.values())) < 120


def template(n, seed, places):
    """Texts of 200 words, some places of which are each one of three words."""
    rng = random.Random(seed)
    words, at = rng.sample([f"v{k}" for k in range(3000)], 200), list(range(5, 200, 200 // places))[:places]
    rows = []
    for i in range(n):
        own = list(words)
        for k in at:
            own[k] = f"p{k}x{rng.randrange(3)}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize(("places", "n"), [(10, 200), (10, 800), (20, 400), (20, 800)])
def test_pairs_of_a_template_grow_with_its_texts(spark, monkeypatch, places, n):
    rows = template(n, 4, places)
    got, pairs = in_one_bucket(spark, rows, 5, monkeypatch)
    assert got == brute_components(sets_of(rows, 5))
    assert pairs < 20 * n
    if places == 20:
        assert len(set(got.values())) > 0.95 * n  # almost none is linked


@pytest.mark.parametrize("places", [10, 20])
def test_a_template_through_all_stages(spark, monkeypatch, places):
    rows = template(400, 5, places)
    pairs, true = [], minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda p, *a: pairs.append(p.count()) or true(p, *a))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(sets_of(rows, 5))
    assert sum(pairs) < 20 * len(rows)


@pytest.mark.parametrize("n", [0, 1, 3, 500, 2049, 9000])
def test_parity_never_overstates_a_difference(n):
    from pagewright.llm import parity

    rng = np.random.default_rng(n)
    a = rng.integers(0, 1 << 63, n).astype(np.uint64)
    b = np.concatenate((a[: n // 2], rng.integers(0, 1 << 63, n // 3).astype(np.uint64)))
    x, y = parity.bits_of(a), parity.bits_of(b)
    words = min(len(x), len(y))
    ones = [int(np.bitwise_count(parity.folded(x[None], w) ^ parity.folded(y[None], w)).sum()) for w in (8, words)]
    assert ones[0] <= ones[1] <= len(set(a.tolist()) ^ set(b.tolist()))
    assert len(x) * 64 >= max(2048, n) and parity.bits_of(np.concatenate((a, a))[: 2 * n]).sum() == 0


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


@pytest.mark.parametrize("n", [8, 9, 256, 257, 512, 4096])
def test_words_that_share_polynomial_hashes_stay_apart(spark, n):
    one, two = thue_morse(n), thue_morse(n, 1)
    texts = [(1, " ".join([one] * 20)), (2, " ".join([two] * 20)), (3, " ".join(f"{two}{k}" for k in range(30))), (4, " ".join(f"{one}{k}" for k in range(30)))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, texts), shingle=2).collect()}
    assert got == {i: i for i, _ in texts}
    cut = {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(frame(spark, texts)).collect()}
    assert cut == {i: 0 for i, _ in texts}
    bench = spark.createDataFrame([(1, " ".join([one] * 13 + [two]))], "item_id bigint, text string")
    hits = {r.doc_id: sum(x.end - x.start for x in r.spans) for r in decontaminate.find_hits(frame(spark, texts), bench).collect()}
    assert hits == {1: 20, 2: 0, 3: 0, 4: 0}


PIPELINE = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = (
    "score n_words spans item_ids kept_id __text n_tokens token_ids lang_pred bits_per_byte ids_sha256 round_trip _c0 c0 id mark lost "
    "bucket node hub root kept component_id n_lines n_removed __letters _n_tokens"
).split()


def test_pipeline_odd_tables(spark, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(i, "\n".join(" ".join(rng.choices(WORDS, k=9)) for _ in range(4)), rng.choice(["en", "de"]), "s", 1) for i in range(30)]
    rows += [rows[3], rows[3], (None, rows[4][1], "en", "s", 0), (None, "null id text here", "en", "s", 0), (77, "", "en", "s", 0), (78, "x" * 1_000_000, "en", "s", 0)]
    rows += [(79, " ".join(rng.choices(WORDS, k=150_000)), "en", "s", 0)]
    docs = spark.createDataFrame(rows, PIPELINE)
    bench = spark.createDataFrame([(1, "nothing of this stands anywhere else")], "item_id bigint, text string")

    def run(table, name):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        return corpus_pipeline.run(spark, f"{tmp_path}/{name}")

    plain = run(docs, "plain")
    clashing = run(docs.select("*", *[F.lit(0.5).alias(c) for c in CLASHING]), "clashing")
    assert clashing.columns == [*docs.columns, *CLASHING, "__n_tokens", "_ids_sha256", "_round_trip", "_token_ids"]
    assert clashing.where(" and ".join(f"`{c}` = 0.5" for c in CLASHING)).count() == clashing.count()
    key = lambda t: sorted(map(str, t))
    assert key(plain.select("doc_id", "text", "n_chars", "ids_sha256").collect()) == key(clashing.selectExpr("doc_id", "text", "n_chars", "_ids_sha256 ids_sha256").collect())
    ids = Counter(r.doc_id for r in plain.collect())
    assert ids[3] == 3 and ids[None] >= 1 and {78, 79} <= set(ids) and not {77} & set(ids)
    none = run(docs.limit(0), "none")
    assert none.collect() == [] and none.columns == plain.columns


def proto(*fields):
    """A protocol buffer message of (number, int, float, str or bytes) fields."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, x in fields:
        if isinstance(x, int):
            out += varint(number << 3) + varint(x)
        elif isinstance(x, float):
            out += varint(number << 3 | 5) + struct.pack("<f", x)
        else:
            x = x.encode() if isinstance(x, str) else x
            out += varint(number << 3 | 2) + varint(len(x)) + x
    return out


def unigram_model():
    rng = random.Random(2)
    texts = sorted({"▁", *"abcde", *("".join(rng.choices("▁abcde", k=1)) + "".join(rng.choices("abcde", k=rng.choice([1, 1, 2, 3]))) for _ in range(60))})
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    pieces += [(t, -rng.uniform(1, 9), 1) for t in texts]
    return proto(
        *[(1, proto((1, t), (2, s), (3, k))) for t, s, k in pieces],
        (2, proto((3, 1), (35, 1))),
        (3, proto((1, "identity"), (3, 1), (4, 0), (5, 1))),
    )


def test_shortest_path_of_a_unigram_model_equals_the_library(spark, tmp_path):
    import sentencepiece

    data = unigram_model()
    (tmp_path / "unigram.model").write_bytes(data)
    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcde  zç\U0001f600", k=rng.randrange(80))) for _ in range(300)] + ["", None, "".join(rng.choices("abcde", k=400)), " a"]
    docs = frame(spark, list(enumerate(texts)))
    coded = encoding.encode(docs, model_path=str(tmp_path / "unigram.model"))
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, model_path=str(tmp_path / "unigram.model")).collect()}
    cost = lambda ids: -sum(own.get_score(k) for k in ids if not own.is_byte(k))
    differ = 0
    for r in coded.collect():
        want = own.encode(texts[r.doc_id] or "")
        if r.token_ids != want:  # the same pieces in another order: the library rounds their sum to 32 bits
            assert sorted(r.token_ids) == sorted(want) and cost(r.token_ids) == pytest.approx(cost(want))
            differ += 1
        assert r.round_trip and counts[r.doc_id] == r.n_tokens
    assert differ <= 5


@pytest.mark.parametrize("data", [unigram_model(), None], ids=["unigram", "bpe"])
def test_forward_scores_sum_over_all_cuts(data):
    from math import exp, log

    from pagewright.llm import pieces

    machine = pieces.Transducer(pieces.PieceModel(data or encoding.model_bytes(None)))
    trie, law, ids = token_counts.Trie(machine), machine.model.law(), machine.model.id
    if data is None:
        assert sum(map(exp, law)) == pytest.approx(1)

    def brute(s):
        if not s:
            return 1.0
        total = sum(exp(law[ids[s[:k]]]) * brute(s[k:]) for k in range(1, len(s) + 1) if s[:k] in ids)
        return total if s[0] in ids else exp(sum(law[k] for k in machine.fallback(s[0]))) * brute(s[1:])

    for text in ["abcab", "abcd", "abzçe", "the cab", "a", "abcab abcab", "dead bee"]:
        words = machine.pretokens(text)
        [(n, tokens, score)] = trie.totals([text])
        assert (n, tokens) == (len(words), len(machine.encode(text)))
        assert score == pytest.approx(sum(log(brute(w)) for w in words))
    assert "".join(machine.pretokens("a  b c")) == machine.normaliser("a  b c")


@pytest.mark.parametrize("n", [63, 64, 65, 300])
def test_long_pretokens_take_the_same_recurrence(n, monkeypatch):
    from pagewright.llm import pieces

    machine = pieces.Transducer(pieces.PieceModel(encoding.model_bytes(None)))
    text = "".join(random.Random(n).choices("abcdefgh", k=n - 1))
    told = list(token_counts.Trie(machine).totals([text, text + " x", text]))
    monkeypatch.setattr(token_counts, "LONGEST", 10_000)
    want = list(token_counts.Trie(machine).totals([text, text + " x", text]))
    assert told == want and told[0] == told[2] and told[0][1] == len(machine.encode(text))


@pytest.mark.parametrize("data", [unigram_model(), None], ids=["unigram", "bpe"])
def test_pretokens_of_texts_are_encoded_together(data, monkeypatch):
    from pagewright.llm import lockstep, pieces

    machine = pieces.Transducer(pieces.PieceModel(data or encoding.model_bytes(None)))
    rng = random.Random(12)
    letters = "abcde zç\U0001f600" if data else "abcdeéstng \n1,.漢\U0001f600\u0378"
    texts = ["".join(rng.choices(letters, k=rng.randrange(200))) for _ in range(150)] + ["", None, "e" * 64 + " " + "e" * 65 + " a", "漢" * 70, "▁ ▁"]
    want = [machine.encode(t or "") for t in texts]
    words = list(dict.fromkeys(w for t in texts for w in machine.pretokens(t or "") if len(w) <= 64))
    ids, ends = lockstep.Lockstep(machine)(words)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [machine(w) for w in words]
    # with room in the table and without; only long pre-tokens are taken one by one
    alone = []
    one = pieces.Transducer.__call__
    monkeypatch.setattr(pieces.Transducer, "__call__", lambda self, s: alone.append(s) or one(self, s))
    for most in (encoding.MOST_PATHS, 40):
        monkeypatch.setattr(encoding, "MOST_PATHS", most)
        monkeypatch.setattr(encoding, "TOGETHER", 16)
        paths = encoding.Paths(machine)
        for _ in range(2):
            got = [list(memoryview(raw).cast("i")) for raw in paths.encode(texts)]
            assert got == want and len(paths) <= most
    assert alone and all(len(s) > 64 for s in alone)
    assert list(encoding.Paths(machine).encode([])) == []


def test_a_full_table_keeps_what_is_asked_for_again(monkeypatch):
    from pagewright.llm import lockstep, pieces

    monkeypatch.setattr(encoding, "MOST_PATHS", 50)
    paths = encoding.Paths(pieces.Transducer(pieces.PieceModel(encoding.model_bytes(None))))
    made = Counter()
    one = lockstep.Lockstep.__call__
    monkeypatch.setattr(lockstep.Lockstep, "__call__", lambda self, words: made.update(words) or one(self, words))
    for k in range(60):
        list(paths.encode([" ".join(["the same few", *(f"once{chr(97 + j)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for j in range(8))])]))
    assert made["▁the"] == made["▁same"] == made["▁few"] == 1 and made["▁onceaaa"] == 1 and len(paths) <= 50


def test_pairs_are_judged_alike_in_arrays():
    from pagewright.llm import lockstep, pieces

    machine = pieces.Transducer(pieces.PieceModel(encoding.model_bytes(None)))
    steps, ids, rng = lockstep.Lockstep(machine), machine.model.id, random.Random(3)
    some = [ids[t] for t in (*sorted(machine.tied)[:20], *rng.sample(sorted(ids), 120), *(c for c in "aest▁" if c in ids))]
    # halves of pieces as well: pairs that merge
    halves = [machine.split(t) for t in rng.sample(sorted(ids), 400) if len(t) > 1]
    pairs = [(a + 1, b) for a in some for b in some] + [(0, b) for b in some] + [(ids[a] + 1, ids[b]) for a, b in filter(None, halves)]
    want = [machine.judge(a, b) for a, b in pairs]
    before, piece = np.array(pairs, np.int64).T
    assert steps._judge(before, piece).tolist() == want and {True, False} <= set(want)
    steps.MOST_PAIRS = 100
    for _ in range(2):
        got = [steps._may_follow(before[i : i + 64].copy(), piece[i : i + 64].copy()).tolist() for i in range(0, len(pairs), 64)]
        assert [x for some in got for x in some] == want and steps.follows.size <= 100


def test_untied_pieces_take_the_fast_pair_check():
    from pagewright.llm import pieces

    machine = pieces.Transducer(pieces.PieceModel(encoding.model_bytes(None)))
    assert 0 < len(machine.tied) < 100
    words = ["▁the", *random.Random(1).sample(sorted(machine.model.id), 60)]
    assert sum(len(w) == 1 or machine.split(w) is not None for w in words) >= 60
    for x in words:
        for y in words:
            assert machine._apart(x, y) == (machine.merged(x + y) == [x, y])


def test_scores_of_whole_texts_equal_a_plain_forward_pass(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(WORDS[:25], k=rng.choice([0, 1, 7, 400])))) for i in range(40)] + [(90, None), (91, "never seen words"), (7, "w1 w1")]
    kept = {}
    for name in ("baum_welch", "head_of"):
        true = getattr(lm, name)
        monkeypatch.setattr(lm, name, lambda *a, true=true, name=name: kept.setdefault(name, true(*a)))
    got = lm.score(lm.with_fold(frame(spark, rows)), head=12, states=3, rounds=2).collect()
    model, head = kept["baum_welch"], kept["head_of"]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w.encode() for i, t in rows if not fold(i) for w in split((t or "").lower()))
    assert head.words == sorted(c, key=lambda w: (-c[w], w))[:12]
    want = []
    for i, t in rows:
        alpha, total = None, 0.0
        for w in [*(x.encode() for x in split((t or "").lower())), None]:
            k = head.words.index(w) if w in head.words else len(head.words) + (w is None)
            if k == len(head.words):
                total += log10((c[w] + 0.5) / (head.rare_total + 0.5 * (head.rare_distinct + 1)))
            alpha = (model.start if alpha is None else alpha @ model.move) * model.emit[k]
            total += log10(alpha.sum())
            alpha = alpha / alpha.sum()
        want.append((i, pytest.approx(total, rel=1e-5)))
    assert sorted((r.doc_id, r.score) for r in got) == sorted(want, key=lambda x: (x[0], x[1].expected))


def test_head_is_the_same_however_words_are_dealt(spark):
    words = [(f"w{i:04}", 1 + (i % 7) * (i % 3)) for i in range(500)]
    vocab = spark.createDataFrame(words, "word string, c bigint").repartition(16)
    for head in (1, 3, 250, 499, 600):
        got = lm.head_of(vocab, 10, head)
        assert got.words == [w.encode() for w, _ in sorted(words, key=lambda x: (-x[1], x[0]))[:head]]


def test_code_lengths_equal_plain_prediction_by_partial_matching():
    text, order = b"abracadabra abrakadabra barbara", 3
    seen = defaultdict(Counter)
    for i, b in enumerate(text):
        padded = b"\0" * order + text[:i]
        for k in range(order + 1):
            seen[padded[len(padded) - k :]][b] += 1

    def p(context, b):
        """A context's own bytes by their counts; others by the next shorter context, of which it
        leaves out the bytes it knows."""
        if context is None:
            return 1 / 256
        held, shorter = seen.get(context), context[1:] if context else None
        if not held:
            return p(shorter, b)
        n, t = sum(held.values()), len(held)
        if b in held:
            return held[b] / (n + t)
        return t / (n + t) * p(shorter, b) / (1 - sum(p(shorter, x) for x in held))

    g, n = np.unique(langid.grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]), order), return_counts=True)
    tree = langid.Tree.grown(g, n.astype(float), order)
    for context in (b"abr", b"xyz", b"aka", b"\0\0a", b" ab"):
        keys = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert 2.0 ** tree.logs(keys, order + 1) == pytest.approx([p(context, b) for b in range(256)], rel=1e-4)


def test_many_languages_share_the_sample(spark):
    rows = [(i, f"l{i} " * 30, f"lang{i % 40}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs, sample_chars=10_000, total_chars=20_000)
    assert len(model.langs) <= 40 and all(t.gram for t in model.trees)
    few = langid.train(docs, sample_chars=10_000)
    size = lambda m: sum(len(x) for t in m.trees for x in t.gram)
    assert size(model) < size(few)


def test_index_is_stored_and_searched_alone(spark, docs, rows):
    """Hits come from the postings: a segment that loses a word's list loses the windows with it."""
    texts = dict(rows)
    source = max((t for t in texts.values() if t), key=lambda t: len(split(t)))
    [part] = list(decontaminate.slices(__import__("pyarrow").array([source, "w1 other words", ""]), lower=True, gaps=decontaminate.GAPS))
    segment = decontaminate.Segment.loaded(decontaminate.Segment.of(part).stored())
    words = decontaminate.words_of(source)
    windows = decontaminate.Windows([(1, words[2:15]), (2, words[5:9]), (3, [b"absent", *words[:3]])], 13)
    got = sorted((int(k), int(x)) for w, start in segment.phrases(windows) for k, x in zip(w, start, strict=True))
    want = sorted((k, x) for k, t in enumerate([words[2:15], words[5:9]]) for x in range(len(words) - len(t) + 1) if words[x : x + len(t)] == t)
    assert got == want and want
    for number in range(len(segment.one)):  # every list ascends and holds its word's places
        places = segment.postings(number)
        assert (np.diff(places) > 0).all() and len({[*words, b"w1", b"other", b"words"][p] for p in places}) == 1
    lost = int(segment.numbers(windows.one, windows.two)[windows.terms[0, 4]])
    segment.two = segment.two.copy()
    segment.two[lost] += np.uint32(1)
    assert not any((w == 0).any() for w, _ in segment.phrases(windows))


def test_decontamination_of_empty_tables(spark, empty, docs):
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert decontaminate.find_hits(empty, bench).collect() == []
    none = decontaminate.find_hits(docs, bench.limit(0), id_columns=("doc_id", "node", "text"))
    assert none.columns[:3] == ["doc_id", "node", "text"] and none.where("size(spans) > 0").count() == 0 and none.count() == docs.count()
    one = spark.createDataFrame([(1, "Word word")], "doc_id bigint, text string")
    bench1 = spark.createDataFrame([(1, "word"), (2, "word word"), (3, "word x")], "item_id bigint, text string")
    assert [(r.item_ids, [tuple(x) for x in r.spans]) for r in decontaminate.find_hits(one, bench1).collect()] == [([1, 2], [(0, 2)])]
    long = spark.createDataFrame([(1, "q " * 400_000 + "a b c"), (None, "x" * 1_500_000), (2, None), (2, "a b c"), (2, "a b c")], "doc_id bigint, text string")
    got = sorted(((r.doc_id or 0, r.n_words, r.item_ids) for r in decontaminate.find_hits(long, bench).collect()), key=str)
    assert got == [(0, 1, []), (1, 400_003, [1]), (2, 0, []), (2, 3, [1]), (2, 3, [1])]


def test_exact_of_the_greatest_id_and_of_none(spark):
    most = (1 << 63) - 1
    rows = [(most, "a b"), (None, "ab"), (most, "c"), (None, "d"), (None, "d "), (-(1 << 63), "e"), (most, "e"), (7, "f"), (7, "f"), (8, " f")]
    got = exact_dedup.exact_duplicates(frame(spark, rows)).select("doc_id", "keep_id", "group_size", "kept").collect()
    want = [(most, most, 2, True), (None, most, 2, False), (most, most, 1, True), (None, None, 2, True), (None, None, 2, True), (-(1 << 63), -(1 << 63), 2, True),
            (most, -(1 << 63), 2, False), (7, 8, 3, False), (7, 8, 3, False), (8, 8, 3, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_index_row_groups_are_small(spark, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    paths = []
    put = _common.Shelf.put
    monkeypatch.setattr(_common.Shelf, "put", lambda *a, **b: paths.append((out := put(*a, **b))._shelf_path) or out)
    texts = [(i, f"w{i} " * 60_000) for i in range(20)]  # a segment each
    bench = spark.createDataFrame([(1, "w7 w7 w7")], "item_id bigint, text string")
    told = decontaminate.find_hits(spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1), bench).collect()
    assert sorted((r.doc_id, r.n_words, r.item_ids) for r in told) == [(i, 60_000, [1] * (i == 7)) for i in range(20)]
    files = [pq.ParquetFile(f).metadata for f in glob.glob(paths[0].removeprefix("file:") + "/*.parquet")]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert sum(groups) == 20 and max(groups) <= 8


def test_tables_of_a_worker_go_when_another_stage_begins():
    import gc
    import weakref

    held = weakref.ref(encoding.Paths.of(encoding.model_bytes(None)))
    list(_common.tidy(lambda batches: iter(batches), tables=True)([1]))
    gc.collect()
    assert held() is not None
    assert list(_common.tidy(lambda batches: iter(batches))([1, 2])) == [1, 2]
    gc.collect()
    assert held() is None


def test_batches_of_long_texts_are_small(spark):
    docs = spark.createDataFrame([(i, "x" * 500_000) for i in range(40)], "doc_id bigint, text string").coalesce(1)
    _common.small_batches(spark)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    sizes = [r.n for r in docs.mapInArrow(run, "n bigint").collect()]
    assert sum(sizes) == 40 and max(sizes) <= 6
