"""Clips, link regions, codes that are no text, and CMaps joined with CMaps."""

import math
import random
import time

import pytest

from pagewright.plans import write
from pagewright.sources import fonts, geometry, pdf


def page(body: bytes, extra: bytes = b"", w=None):
    w = w or write.Writer()
    w.shared += b"/Resources<</Font<</F1 %d 0 R>>%s>>" % (w.font(), extra)
    w.pages([write.stream(body)])
    [p] = pdf.extract(w.table())
    return p


# ------------------------------------------------------------------ areas and clips
def square(x, y, a, b=None):
    b = a if b is None else b
    return [(x, y), (x + a, y), (x + a, y + b), (x, y + b)]


def test_common_areas():
    area = geometry.common_area
    assert area([([square(0, 0, 10)], False)]) == 100
    assert area([([square(0, 0, 10)], False), ([square(5, 5, 10)], False)]) == 25
    assert area([([square(0, 0, 10)], False), ([square(20, 5, 10)], False)]) == 0
    ring = [square(0, 0, 10), square(2, 2, 6)]
    assert area([(ring, True)]) == 64 and area([(ring, False)]) == 100
    assert area([([square(0, 0, 10), square(2, 2, 6)[::-1]], False)]) == 64
    assert area([([[(0, 0), (10, 0), (0, 10)]], False), ([square(0, 0, 5)], False)]) == pytest.approx(25)
    star = [(math.cos(4 * math.pi * k / 5), math.sin(4 * math.pi * k / 5)) for k in range(5)]
    assert area([([star], False)]) > area([([star], True)]) > 0
    assert area([([], False), (ring, False)]) == 0


def test_areas_of_random_polygons_equal_a_grid():
    rng = random.Random(3)

    def inside(shape, odd, x, y):
        wind = 0
        for p in shape:
            for (ax, ay), (bx, by) in zip(p, [*p[1:], *p[:1]], strict=True):
                if (ay <= y) != (by <= y) and ax + (y - ay) / (by - ay) * (bx - ax) > x:
                    wind += 1 if by > ay else -1
        return bool(wind & 1 if odd else wind)

    for _ in range(6):
        shapes = [([[(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(rng.randrange(3, 7))] for _ in range(rng.randrange(1, 3))], rng.random() < 0.5) for _ in range(rng.randrange(1, 4))]
        n = 150
        seen = sum(all(inside(s, odd, (i + 0.5) / n * 10, (j + 0.5) / n * 10) for s, odd in shapes) for i in range(n) for j in range(n)) / n / n * 100
        assert geometry.common_area(shapes) == pytest.approx(seen, abs=0.8)


def test_clips_nest_and_end_with_their_state():
    body = b"q 0 0 100 100 re W n q 50 50 100 100 re W* n 0 0 200 200 re f Q 0 0 200 200 re f Q 0 0 200 200 re f"
    p = page(body)
    assert [f["visible"] for f in p["fills"]] == [2500, 10_000, None]
    clips = [x["clips"] for x in p["paths"]]
    assert [c and [k["fill_rule"] for k in c] for c in clips] == [["nonzero", "evenodd"], ["nonzero"], None]
    assert clips[0][0]["d"] == "M 0 0 L 100 0 L 100 100 L 0 100 Z"


def test_a_clip_that_is_painted_holds_from_there_and_a_lost_one_does_not():
    p = page(b"W n 0 0 10 10 re W f 0 0 20 20 re f")  # no path yet: no clip
    assert [f["visible"] for f in p["fills"]] == [100, 100]
    p = page(b"0 0 10 10 re W Q 0 0 20 20 re f")  # the state ends before the path is used
    assert [f["visible"] for f in p["fills"]] == [None, None]


def test_a_shading_fills_its_clip_only():
    extra = b"/Shading<</S<</ShadingType 2/Function<</FunctionType 2/C0[1 0 0]/C1[0 0 1]/N 1>>>>>>"
    p = page(b"/S sh q 10 10 80 80 re W n 30 40 20 20 re W n /S sh Q /S sh", extra)
    [f], [x] = p["fills"], p["paths"]
    assert f["visible"] == 400 and {(q["x"], q["y"]) for q in f["points"]} == {(30, 40), (50, 40), (50, 60), (30, 60)}
    assert x["fill"] == "#800080" and [c["d"] for c in x["clips"]] == ["M 10 10 L 90 10 L 90 90 L 10 90 Z"]


def test_forms_and_images_have_the_clips_around_them():
    w = write.Writer()
    form = w.add(write.stream(b"0 0 50 50 re f", b"/Type/XObject/Subtype/Form/BBox[0 0 99 99]"))
    raw = w.add(write.stream(b"\x01\x02\x03", b"/Type/XObject/Subtype/Image/Width 1/Height 1/BitsPerComponent 8/ColorSpace/DeviceRGB"))
    p = page(b"q 0 0 20 20 re W n /A Do /B Do Q /B Do", b"/XObject<</A %d 0 R/B %d 0 R>>" % (form, raw), w)
    assert p["fills"][0]["visible"] == 400 and [i["clips"] and len(i["clips"]) for i in p["images"]] == [1, None]


def test_curved_clips():
    k = 0.5523
    circle = b"100 50 m 100 %f %f 100 50 100 c %f 100 0 %f 0 50 c 0 %f %f 0 50 0 c %f 0 100 %f 100 50 c W n 0 0 100 100 re f" % tuple(50 + 50 * s * k for s in (1, 1, -1, 1, -1, -1, 1, -1))
    assert page(circle)["fills"][0]["visible"] == pytest.approx(math.pi * 2500, rel=0.02)


# ------------------------------------------------------------------ links
def linked(annotation: bytes, *shown: bytes):
    w = write.Writer()
    w.shared += b"/Resources<</Font<</F1 %d 0 R>>>>" % w.font()
    w.pages([write.stream(b" ".join(shown))], [b"/Annots[<</Subtype/Link/A<</S/URI/URI(https://x.org)>>%s>>]" % annotation])
    [p] = pdf.extract(w.table())
    return [s["text"] for s in p["spans"] if s.get("href")]


def test_a_turned_region_takes_only_the_spans_inside_it():
    # a band from lower left to upper right; both spans lie in the box around it
    c = math.sqrt(0.5)
    along = b"BT /F1 10 Tf %f %f %f %f 110 105 Tm (along) Tj ET" % (c, c, -c, c)
    beside = write.show(150, 105, 10, b"(beside)")
    quad = b"/Rect[90 90 220 220]/QuadPoints[100 90 210 200 200 215 90 105]"
    assert linked(quad, along, beside) == ["along"]
    assert linked(b"/Rect[90 90 220 220]", along, beside) == ["along", "beside"]
    # corners in the order of the standard's figure and in that of most writers
    for q in (b"100 700 160 700 160 712 100 712", b"100 712 160 712 100 700 160 700"):
        assert linked(b"/Rect[0 0 1 1]/QuadPoints[%s]" % q, write.show(101, 702, 10, b"(in it)"), write.show(101, 650, 10, b"(out)")) == ["in it"]
    assert linked(b"/Rect[100 700 160 712]/QuadPoints[1 2 3]", write.show(101, 702, 10, b"(in it)")) == ["in it"]


# ------------------------------------------------------------------ codes
def composite(encoding: bytes, shown: bytes, more: bytes = b""):
    w = write.Writer()
    below = w.add(b"<</Type/Font/Subtype/CIDFontType2/BaseFont/B/DW 500%s>>" % more)
    font = w.font(b"/Subtype/Type0/BaseFont/B/Encoding%s/DescendantFonts[%d 0 R]" % (encoding, below))
    w.pages([write.stream(write.show(40, 700, 10, shown))], [b"/Resources<</Font<</F1 %d 0 R>>>>" % font])
    return w.table()


def test_codes_that_are_half_a_pair():
    [p] = pdf.extract(composite(b"/Identity-H", b"<0041D83D0042>"))
    assert p["spans"][0]["text"] == "A�B"
    [p] = pdf.extract(composite(b"/UniJIS-UTF16-H", b"<0041D83DDE000042D800>"))
    assert p["spans"][0]["text"] == "A\U0001f600B�"
    assert fonts.glyph_text("uniD83DDE00") == "\U0001f600" and fonts.glyph_text("uniD83D") == "�" and fonts.glyph_text("uD83D") == "�"


@pytest.mark.parametrize("mode", ["PERMISSIVE", "DROPMALFORMED", "FAILFAST"])
@pytest.mark.parametrize("bad", [{"rotate": 1 << 40}, {"spans": [{"text": "\ud83d"}]}, {"width": "wide"}])
def test_a_file_that_arrow_refuses_fails_alone(spark, mode, bad):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from pagewright.schema import PAGES

    schema = to_arrow_schema(StructType.fromDDL(PAGES))
    rows = [{"doc_id": "a", "page": 1}, {"doc_id": "b", "page": 1}, {"doc_id": "b", "page": 2} | bad, {"doc_id": "c", "page": 1}]
    if mode == "FAILFAST":
        with pytest.raises(Exception):  # noqa: B017  of whatever kind
            pdf.batch_of(rows, schema, mode)
        return
    got = [(r["doc_id"], r["error"] and r["error"]["code"]) for r in pdf.batch_of(rows, schema, mode).to_pylist()]
    assert got == [("a", None), *([("b", "INVALID_PDF")] if mode == "PERMISSIVE" else []), ("c", None)]


def test_ranges_over_their_limits_are_errors():
    with pytest.raises(pdf.PdfError) as e:
        list(pdf.extract(composite(b"/Identity-H", b"<0041>", b"/W[0 70000 300]")))
    assert e.value.code == "RESOURCE_LIMIT"
    assert list(pdf.extract(composite(b"/Identity-H", b"<0041>", b"/W[0 65535 300]")))[0]["spans"][0]["bounds"]["width"] == 3


# ------------------------------------------------------------------ CMaps
def cmap(entries):
    blocks = []
    for a, b, c in entries:
        blocks.append(b"1 begincidrange <%04X> <%04X> %d endcidrange" % (a, b, c) if b is not None else b"1 begincidchar <%04X> %d endcidchar" % (a, c))
    return fonts.CidMap(b"\n".join(blocks))


@pytest.mark.parametrize("seed", range(5))
def test_overlapping_ranges_equal_a_table_of_all_codes(seed):
    rng = random.Random(seed)
    entries = [(a := rng.randrange(400), rng.choice([None, a, a + rng.randrange(200), a - 1]), rng.randrange(1000)) for _ in range(60)]
    table = {}
    for a, b, c in entries:
        for k in range(a, (a if b is None else b) + 1):
            table[k] = c + k - a
    codes = rng.sample(range(700), 300)
    assert cmap(entries).cids(codes) == {k: table[k] for k in codes if k in table}


def test_many_ranges_that_all_overlap():
    held = cmap([(0, 0xFFFF, 0)] * 65_535 + [(5, 6, 900)])
    began = time.time()
    got = held.cids(range(0x10000))
    assert time.time() - began < 5 and got[5] == 900 and got[7] == 7 and len(got) == 0x10000
    assert cmap([(0, 1, 0)] * 65_537).cids([0]) == {}  # over the bound none counts


def test_characters_joined_with_cids():
    to = fonts.CMap(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 3 beginbfchar <0001> <0041> <0002> <0042> <0003> <00660069> endbfchar")
    assert fonts.glyphs_by_character(to, None) == {0x41: 1, 0x42: 2, 0x66: 3}
    assert fonts.glyphs_by_character(to, cmap([(1, 2, 70), (3, None, 5), (2, None, 9)])) == {0x41: 70, 0x42: 9, 0x66: 5}


def test_widths_go_by_cid():
    w = write.Writer()
    enc = w.add(write.flate(b"1 begincidrange <0041> <0042> 7 endcidrange"))
    below = w.add(b"<</Type/Font/Subtype/CIDFontType2/BaseFont/B/DW 500/W[7[250] 8[750]]>>")
    font = w.font(b"/Subtype/Type0/BaseFont/B/Encoding %d 0 R/DescendantFonts[%d 0 R]" % (enc, below))
    w.pages([write.stream(write.show(40, 700, 10, b"<00410042>"))], [b"/Resources<</Font<</F1 %d 0 R>>>>" % font])
    [p] = pdf.extract(w.table())
    assert p["spans"][0]["bounds"]["width"] == 10


def test_drawings_keep_their_clips():
    from pagewright.operators import media

    p = page(b"q 0 0 100 100 re W n q 20 20 300 300 re W* n 10 10 200 200 re f Q 0 0 50 50 re S Q q 0 0 5 5 re W n 40 40 9 9 re f Q")
    parts = [("path", x) for x in p["paths"]] + [("fill", f) for f in p["fills"]]
    drawn = media.svg(media.Media(media.Box(0.0, 0.0, 210.0, 210.0), "vector", parts), 792.0)
    assert '<defs><clipPath id="c0-0"><path d="M 0 0 L 100 0 L 100 100 L 0 100 Z"/></clipPath><clipPath id="c0-1"><path d="M 20 20 L 320 20 L 320 320 L 20 320 Z" clip-rule="evenodd"/></clipPath></defs>' in drawn
    assert '<g clip-path="url(#c0-0)"><g clip-path="url(#c0-1)"><path d="M 10 10' in drawn and drawn.count("<polygon") == 1  # of the last fill nothing shows
    bad = media._clipped("<path/>", [{"d": 'M 0 0"/><script>', "fill_rule": "nonzero"}], 1)
    assert bad == "<path/>"


@pytest.mark.parametrize(("face", "text", "width"), [
    ("Times-Roman", "Wi.", 1472), ("Times-Bold", "Wi.", 1528), ("Times-Italic", "Wi.", 1361), ("Times-BoldItalic", "Wi.", 1417), ("Helvetica", "Wi.", 1444),
    ("Helvetica-BoldOblique", "Wi.", 1500), ("Courier-BoldOblique", "Wi.", 1800),
])
def test_widths_of_standard_faces(face, text, width):
    held = fonts.standard_widths(face)
    assert len(held) == 95 and sum(held[c] for c in text) == width
