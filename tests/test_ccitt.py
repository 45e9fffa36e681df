"""Group 4 masks and Type 3 glyphs: what the writer encodes comes back bit for bit."""

import time

import numpy as np
import pytest

from pagewright.plans import write
from pagewright.sources import ccitt, pdf


def test_codes_are_prefix_free_and_complete_enough():
    for black in (False, True):
        codes = [*ccitt.run_codes(black).values(), "000000000001"]
        assert len(set(codes)) == len(codes)
        assert not any(a != b and b.startswith(a) for a in codes for b in codes)
        # all that is left free begins with seven zeros
        assert all(sum(c.startswith(f"{k:07b}") or f"{k:07b}".startswith(c) for c in codes) for k in range(1, 128))
    modes = list(ccitt.MODES.values())
    assert not any(a != b and b.startswith(a) for a in modes for b in modes)


def test_known_data():
    # three white rows of eight: each equals the line above
    assert ccitt.group4(bytes([0b11100000]), 8, 3) == b"\xff\xff\xff"
    # one row by runs: white 2 (0111), black 3 (10), then white to the end above (V0)
    bits = "001" + "0111" + "10" + "1"
    assert ccitt.group4(int(bits.ljust(16, "0"), 2).to_bytes(2), 8, 1, black_is_1=True) == bytes([0b00111000])
    # the next row shifted right by one: VR1, VR1, V0
    bits += "011" + "011" + "1"
    assert ccitt.group4(int(bits.ljust(24, "0"), 2).to_bytes(3), 8, 2, black_is_1=True) == bytes([0b00111000, 0b00011100])
    # a row whose run above is passed: white to the end
    bits = "001" + "0111" + "10" + "1" + "0001" + "1"
    assert ccitt.group4(int(bits.ljust(24, "0"), 2).to_bytes(3), 8, 2, black_is_1=True) == bytes([0b00111000, 0])


def images():
    rng = np.random.default_rng(1)
    yield np.zeros((5, 7), np.uint8)
    yield np.ones((3, 9), np.uint8)
    yield (rng.random((60, 1)) < 0.5).astype(np.uint8)
    for share in (0.02, 0.3, 0.5, 0.97):
        yield (rng.random((40, 301)) < share).astype(np.uint8)
    wide = np.zeros((3, 9000), np.uint8)
    wide[0, 3000:8800], wide[1, 100:103], wide[2, 3001:8799] = 1, 1, 1
    yield wide
    blob = np.add.outer((np.arange(300) - 150) ** 2, (np.arange(500) - 250) ** 2) < 140**2
    yield (blob ^ (np.arange(500) // 7 % 2 == 1)).astype(np.uint8)


@pytest.mark.parametrize("image", list(images()), ids=lambda i: str(i.shape))
def test_round_trips(image):
    data = ccitt.encoded(image)
    h, w = image.shape
    want = np.packbits(image, axis=1)
    assert ccitt.group4(data, w, h, black_is_1=True) == want.tobytes()
    assert ccitt.group4(data, w, None, black_is_1=True) == want.tobytes()
    white = np.packbits(1 - image, axis=1).tobytes()
    assert ccitt.group4(data, w, h) == white


def test_limits_and_damage():
    with pytest.raises(pdf.PdfError) as e:
        ccitt.group4(b"\xff" * 100, 4096, 2049)
    assert e.value.code == "RESOURCE_LIMIT"
    with pytest.raises(pdf.PdfError):
        ccitt.group4(b"", 0, 5)
    with pytest.raises(pdf.PdfError) as e:
        ccitt.group4(b"\xff" * 4000, 4096)  # rows without end, each like the one above
    assert e.value.code == "RESOURCE_LIMIT"
    began = time.time()
    assert set(ccitt.group4(b"\xff" * 300, 4096, 2048)) == {0xFF} and time.time() - began < 5
    assert ccitt.group4(b"\x00\x00", 8, 2) == b"\xff\xff"  # what is lost is white


def test_the_filter_of_a_stream():
    image = next(i for i in images() if i.shape == (40, 301))
    w = write.Writer()
    n = w.add(write.stream(ccitt.encoded(image), b"/Filter/CCITTFaxDecode/DecodeParms<</K -1/Columns 301/Rows 40/BlackIs1 true>>"))
    w.pages([write.stream(b"")])
    doc = pdf.Document(w.table())
    assert doc.decoded(doc.object(n)) == np.packbits(image, axis=1).tobytes()


def type3(w, image):
    data = ccitt.encoded(image)
    mask = b"%d 0 0 0 %d %d d1 %d 0 0 %d 0 0 cm BI /W %d /H %d /IM true /F /CCF /DP <</K -1 /Columns %d>> ID %s EI" % (
        image.shape[1], image.shape[1], image.shape[0], image.shape[1], image.shape[0], image.shape[1], image.shape[0], image.shape[1], data,
    )
    box = w.add(write.stream(b"500 0 0 0 500 500 d1 100 100 300 300 re f"))
    glyph = w.add(write.stream(mask))
    return w.add(
        b"<</Type/Font/Subtype/Type3/FontMatrix[0.001 0 0 0.001 0 0]/FontBBox[0 0 9 9]/FirstChar 97/LastChar 98/Widths[500 750]"
        b"/CharProcs<</a %d 0 R/b %d 0 R>>/Encoding<</Differences[97/a/b]>>>>" % (box, glyph)
    )


def test_type3_glyphs_are_fills_and_advances():
    image = np.zeros((4, 6), np.uint8)
    image[0, 1:3] = image[2, :] = 1
    w = write.Writer()
    w.pages([write.stream(write.show(40, 700, 10, b"(ab)"))], [b"/Resources<</Font<</F1 %d 0 R>>>>" % type3(w, image)])
    data = w.table()
    [p] = pdf.extract(data)
    assert p["spans"][0]["bounds"]["width"] == pytest.approx(12.5)
    [font] = pdf.fonts_in("f", data)
    a, b = sorted(font["glyphs"], key=lambda g: g["code"])
    assert (a["code"], a["advance"], b["code"], b["advance"]) == (97, 0.5, 98, 0.75) and font["format"] == "type3"
    assert {(q["x"], q["y"]) for q in a["fills"][0]["points"]} == {(0.1, 0.1), (0.4, 0.1), (0.4, 0.4), (0.1, 0.4)}
    boxes = [(min(q["x"] for q in f["points"]), min(q["y"] for q in f["points"]), max(q["x"] for q in f["points"]), max(q["y"] for q in f["points"])) for f in b["fills"]]
    # in the mask a painted pixel is a 0 bit, which is black; rows go from the top
    assert sorted(tuple(round(1000 * v, 6) for v in x) for x in boxes) == [(0, 1, 6, 2), (1, 3, 3, 4)]


def test_fonts_of_files_are_one_row_each(spark):
    from pyspark.sql import functions as F

    image = np.eye(4, dtype=np.uint8)

    def a_file(pages):
        w = write.Writer()
        three, plain = type3(w, image), w.font()
        w.shared += b"/Resources<</Font<</F1 %d 0 R/F2 %d 0 R>>>>" % (three, plain)
        w.pages([write.stream(write.show(40, 700, 10, b"(ab)")) for _ in range(pages)])
        return w.table()

    files = spark.createDataFrame([("x", a_file(3)), ("y", a_file(1)), ("bad", b"broken")], "doc_id string, content binary")
    got = pdf.fonts_of(files)
    assert got.where("error is null").count() == 4 and got.where("error is not null").count() == 1
    one = pdf.font_assets(got).collect()
    assert {(r.format, r.doc_id, r.page) for r in one} == {("type3", "x", 1)} and len(one[0].glyphs) == 2
    spans = pdf.pages_of(files).where("error is null").select("doc_id", "page", F.explode("spans").alias("s")).select("doc_id", "page", "s.font_name", "s.text")
    met = pdf.spans_with_fonts(spans, got).collect()
    assert len(met) == 4 and {r.font_id for r in met} == {one[0].font_id}
