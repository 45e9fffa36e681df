"""Object streams by intervals: bounded buffers, restarts, headers and what is refused."""

import random
import time
import tracemalloc
import zlib

import pytest

from pagewright.plans import write
from pagewright.sources import pdf
from pagewright.sources.containers import PIECE, RESTARTS, Container, Damaged, TooLarge

LIMITS = {"most": 64 << 20, "object_bytes": 1 << 20, "index_bytes": 16 << 20}


def container(header: bytes, body: bytes, n=2, flate=True, **limits):
    raw = header + body
    return Container(zlib.compress(raw) if flate else raw, flate, n, len(header), **(LIMITS | limits))


@pytest.mark.parametrize("index_bytes", [16 << 20, 1 << 10])
def test_a_large_container_is_read_by_stretches(index_bytes):
    n, size = 163_053, 290
    header = " ".join(f"{k + 10} {size * k}" for k in range(n)).encode() + b" "
    body = b"".join(b"(%-*d)" % (size - 2, k) for k in range(n))
    assert len(body) > 45_000_000
    held = container(header, body, n, index_bytes=index_bytes)
    began = time.time()
    for k in random.Random(1).sample(range(n), 200 if index_bytes > 1 << 20 else 8) + [0, n - 1]:
        assert held.object(k + 10, k) == b"(%-*d)" % (size - 2, k)
    assert time.time() - began < 20
    assert held.peak < 128 << 10 and len(held.restarts) <= RESTARTS
    assert held.size == len(header) + len(body)
    assert held.held() < 8 << 20


def test_restarts_save_decoding():
    n = 3000
    header = " ".join(f"{k} {10_000 * k}" for k in range(n)).encode() + b" "
    held = container(header, b"".join(b"%-10000d" % k for k in range(n)), n)
    for k in range(0, n, 10):
        assert int(held.object(k, k)) == k
    assert held.decoded < 30_000_000 + 300 * 2 * held.step


@pytest.mark.parametrize("index", [0, 1, 200])
def test_the_number_counts_before_the_index(index):
    assert container(b"10 0 11 5 ", b"true false").object(11, index) == b"false"


def test_a_repeated_number_goes_by_its_index():
    held = container(b"7 0 7 5 8 11 ", b"true false null", 3)
    assert [held.object(7, k).strip() for k in (0, 1, 2)] == [b"true", b"false", b"true"]
    assert held.object(8, 2) == b"null"


@pytest.mark.parametrize("index_bytes", [1 << 20, 0])
def test_unsorted_places_end_at_the_next_greater_one(index_bytes):
    held = container(b"10 5 11 0 12 5 ", b"true false", 3, index_bytes=index_bytes)
    assert held.object(10, 0) == b"false" and held.object(11, 1) == b"true " and held.object(12, 2) == b"false"


@pytest.mark.parametrize("header", [b"10% comment\n0 11 5", b"%" + b"x" * 65_534 + b"\n10 0 11 5 ", b" " * 65_535 + b"10 0 11 5 ", b"+10 +0 +11 +5 ", b"%" + b"y" * (3 * PIECE) + b"\r10\x000\x0c11 5 "])
@pytest.mark.parametrize("flate", [True, False])
def test_headers_over_pieces(header, flate):
    held = container(header, b"true false", flate=flate)
    assert held.object(11, 1) == b"false" and held.peak < 200_000


def test_bare_deflate():
    raw = zlib.compress(b"10 0 11 5 true false")[2:-4]
    assert Container(raw, True, 2, 10, **LIMITS).object(11, 1) == b"false"


@pytest.mark.parametrize("header", [b"10 -1 11 5 ", b"10 0 11 9007199254740992 ", b"10 0 11 ", b"10 0 11 5 12 9 ", b"10 0 11 5.0 ", b"10 0 11 5%", b"10 0 1" + b"1" * 20 + b" 5 "])
def test_damaged_headers(header):
    with pytest.raises(Damaged):
        container(header, b"true false").object(10, 0)


def test_places_outside_and_lost_checksums():
    with pytest.raises(Damaged, match="outside"):
        container(b"10 0 11 999 ", b"true false").object(11, 1)
    with pytest.raises(Damaged, match="not in"):
        container(b"10 0 11 5 ", b"true false").object(12, 1)
    raw = zlib.compress(b"10 0 11 5 true false")
    for bad in (raw[:-1] + bytes([raw[-1] ^ 1]), raw[:-6]):
        with pytest.raises(Damaged):
            Container(bad, True, 2, 10, **LIMITS).object(11, 1)


def test_limits_of_objects_and_containers():
    with pytest.raises(TooLarge):
        container(b"10 0 11 5 ", b"true false", object_bytes=3).object(11, 1)
    with pytest.raises(TooLarge):
        container(b"10 0 11 5 ", b"true false", most=15).object(11, 1)
    with pytest.raises(TooLarge):
        container(b"10 0 11 5 ", b"true false", most=9)


def packed(n=30, filler=0):
    w = write.Writer()
    w.shared += b"/Resources<</Font<</F1 %d 0 R>>>>" % w.font()
    for _ in range(filler):
        w.add(b"(" + b"filler " * 150_000 + b")")
    w.pages([write.stream(write.show(40, 700, 10, write.literal(f"page {k}"))) for k in range(n)], fan=3)
    return w.packed(60_000)


def test_a_file_over_the_cache_is_read_in_bounded_memory():
    data = packed(300, filler=20)  # 21 MB decoded
    tracemalloc.start()
    began = time.time()
    got = [p["spans"][0]["text"] for p in pdf.extract(data, pdf.Limits(max_object_cache_bytes=64 << 10))]
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert got == [f"page {k}" for k in range(300)]
    assert time.time() - began < 30 and peak < 6 << 20


def test_a_container_over_its_limit_is_an_error_of_its_own():
    with pytest.raises(pdf.PdfError) as e:
        list(pdf.extract(packed(3, filler=3), pdf.Limits(max_object_stream_decoded_bytes=1 << 20)))
    assert e.value.code == "RESOURCE_LIMIT"
