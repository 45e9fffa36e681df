import zlib

import pytest

from pagewright.plans.layout import pdf_bytes
from pagewright.sources import pdf


def texts(data):
    return [[s["text"] for s in p["spans"]] for p in pdf.extract(data)]


def test_values():
    v = pdf.Lexer(rb"<</A#42 [1 -2.5 (a\(b\)\101\n) <616>] /R 3 0 R /N null>>").value()
    assert v == {"AB": [1, -2.5, b"a(b)A\n", b"a\x60"], "R": pdf.Ref((3, 0)), "N": None}


def test_pages_and_recovery():
    data = pdf_bytes([[(40, 700, 10, "One (1)"), (40, 685, 10, "two")], [(40, 700, 12, "Three")]])
    assert texts(data) == [["One (1)", "two"], ["Three"]]
    assert texts(data[: data.rindex(b"xref\n0")] + b"trailer<</Root 1 0 R>>") == texts(data)


def test_filters():
    raw = bytes(range(64)) * 4
    assert pdf.inflate(zlib.compress(raw)) == raw
    assert pdf.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert pdf.unpredict(bytes([2, 1, 2, 2, 1, 1]), {"Predictor": 12, "Columns": 2}) == bytes([1, 2, 2, 3])
    from pagewright.sources.fonts import CMap

    assert CMap(b"1 beginbfrange <01> <03> <0041> endbfrange 1 beginbfchar <09> <00660069> endbfchar").text == {1: "A", 2: "B", 3: "C", 9: "fi"}


def test_errors_stay_in_their_row(spark):
    files = spark.createDataFrame([("a", b"nothing"), ("b", pdf_bytes([[(1, 2, 3, "x")]])), ("c", None)], "doc_id string, content binary")
    got = {r.doc_id: r for r in pdf.pages_of(files).collect()}
    assert got["a"].error.code == got["c"].error.code == "INVALID_PDF"
    assert got["b"].spans[0].bounds.x == 1 and got["b"].spans[0].text == "x"


SF = "/root/testdata/sf0.001"


def _names():
    from pagewright.queries import QUERIES

    return sorted(QUERIES)


@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, name):
    import duckdb

    from pagewright.queries import QUERIES, SQL

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = lambda data: sorted(data, key=str)
    assert rows(tuple(r) for r in got.select(*columns).collect()) == rows(want.fetchall())


def test_lexer_edges():
    v = pdf.Lexer(b"% note\r\n[.5 -.5 5. +7 (plain) (a(b)c) 4 0 R true x1]%end").value()
    assert v == [0.5, -0.5, 5.0, 7, b"plain", b"a(b)c", pdf.Ref((4, 0)), True, "x1"]


# ------------------------------------------------------------------ pages
from pagewright.functions import text as T  # noqa: E402
from pagewright.operators import page as P  # noqa: E402


def sp(text, x, y, width, size=10.0, family="Body", **more):
    return P.Span(float(x), float(y), float(width), more.pop("height", size), 0, text, size, family, **more)


def structured(spans, width=600, height=800, fills=(), paths=(), **options):
    for k, s in enumerate(spans):
        s.seq = k
    return P.structure(width, height, spans, list(fills), list(paths), P.Options(**options))


def line(x1, y1, x2, y2):
    return {"d": f"M {x1} {y1} L {x2} {y2}", "stroke": "#000000", "stroke_opacity": 1.0}


def rows(table):
    return P.table_rows(table)


def test_lines_and_a_borderless_table():
    spans = [sp("Item", 20, 250, 35), sp("Price", 120, 250, 30), sp("Socks", 20, 230, 35), sp("$28", 120, 230, 20), sp("Hat", 20, 210, 20), sp("$12,", 120, 210, 20), sp("sale", 145, 210, 20)]
    lines, tables, blocks = structured(spans)
    assert [x.text for x in lines] == ["Item Price", "Socks $28", "Hat $12, sale"]
    assert rows(tables[0]) == [["Item", "Price"], ["Socks", "$28"], ["Hat", "$12, sale"]]
    assert [b.kind for b in blocks] == ["table"]


def test_rows_need_as_many_cells_aligned_left_or_right():
    right = [sp("a", 20, 100, 30), sp("1,000", 175, 100, 25), sp("b", 20, 85, 30), sp("7", 195, 85, 5)]
    assert rows(structured(right)[1][0]) == [["a", "1,000"], ["b", "7"]]
    ragged = [sp("a", 20, 100, 30), sp("b", 120, 100, 30), sp("c", 220, 100, 30), sp("d", 20, 85, 30), sp("e", 120, 85, 30)]
    assert structured(ragged)[1] == []


@pytest.mark.parametrize(
    ("before", "now", "want"),
    [
        (("word", 0, 20), ("next", 22.5, 20), "word next"), (("word", 0, 20), ("next", 21, 20), "wordnext"), (("a", 0, 5), ("b", 7, 5), "a b"),
        (("1", 0, 5), ("2", 7, 5), "12"), (("1", 0, 5), ("2", 20, 5), "1 2"), (("end.", 0, 20), ("Next", 20, 20), "end. Next"), (("word", 0, 20), (",", 25, 3), "word,"),
        (("well-", 0, 20), ("known", 25, 20), "well-known"), (("(", 0, 4), ("x", 8, 5), "(x"), (("word ", 0, 20), ("x", 40, 5), "word x"), ((".", 0, 2), ("A", 3, 5), ".A"),
    ],
)
def test_space_between_spans(before, now, want):
    assert P.joined([sp(before[0], before[1], 0, before[2]), sp(now[0], now[1], 0, now[2])]) == want
    assert P.joined([sp("x", 0, 0, 5), sp("y", 5, 0, 5, spaced=True)]) == "x y"


def test_superscripts_join_and_the_line_goes_on():
    spans = [sp("mass", 20, 100, 20), sp("2", 40, 105, 3, size=5.0), sp("is", 45, 100, 10), sp("below", 20, 80, 20)]
    assert [x.text for x in structured(spans)[0]] == ["mass2 is", "below"]


def test_column_major_rows_are_merged():
    spans = [sp(f"{c}{r}", 20 + 60 * c, 200 - 15 * r, 15) for c in range(4) for r in range(4)]
    lines, tables, _ = structured(spans)
    assert [x.text for x in lines][0] == "00 10 20 30" and len(rows(tables[0])) == 4


def test_vertical_text_reads_down_from_the_right():
    spans = [sp(t, x, y, 10, vertical=True) for t, x, y in (("三", 100, 90), ("一", 200, 90), ("二", 200, 80), ("四", 100, 80))]
    assert [x.text for x in structured(spans)[0]] == ["一二", "三四"]


def test_wrapped_cell_lines_join_the_last_row():
    spans = [sp("a", 20, 100, 30), sp("one", 120, 100, 30), sp("b", 20, 85, 30), sp("two", 120, 85, 30), sp("more", 121, 74, 30)]
    assert rows(structured(spans)[1][0]) == [["a", "one"], ["b", "two more"]]


def test_ruled_table_with_a_row_over_all_columns():
    spans = [sp("Key", 50, 706, 20), sp("Name", 100, 706, 25), sp("1", 50, 686, 5), sp("x", 100, 686, 5), sp("a note over both columns", 50, 666, 110)]
    paths = [line(40, y, 420, y) for y in (720, 700, 680, 660)]
    table = structured(spans, paths=paths)[1][0]
    assert [(c.row, c.column, c.column_span, c.text) for c in table.cells] == [(0, 0, 1, "Key"), (0, 1, 1, "Name"), (1, 0, 1, "1"), (1, 1, 1, "x"), (2, 0, 2, "a note over both columns")]
    assert P.table_header(table) == ["Key", "Name"] and P.rendered(table)["footer"]
    assert P.covered([(0, 10), (11, 20), (30, 40)]) == 30
    assert [t.reason for t in structured(spans, paths=paths[:2])[1]] == ["repeated-column-alignment"]


def test_upright_rules_part_columns():
    spans = [sp("ab", 50, 706, 10), sp("cd", 62, 706, 10), sp("ef", 50, 686, 10), sp("gh", 62, 686, 10)]
    paths = [line(40, y, 420, y) for y in (720, 700, 680)] + [line(x, 680, x, 720) for x in (40, 61, 420)]
    assert rows(structured(spans, paths=paths)[1][0]) == [["ab", "cd"], ["ef", "gh"]]


def test_panels_give_captions_and_footers():
    spans = [sp("Totals", 50, 144, 30, family="Body-Bold"), sp("a", 50, 130, 20), sp("1", 150, 130, 20), sp("b", 50, 115, 20), sp("2", 150, 115, 20), sp("All amounts in euros, and more", 50, 98, 110)]
    outline = {"d": "M 45 96 L 175 96 L 175 157 L 45 157 Z", "stroke": "#000000", "stroke_opacity": 1.0}
    table = structured(spans, paths=[outline, line(45, 111, 180, 111)])[1][0]
    assert [x.text for x in table.caption] == ["Totals"]
    assert table.cells[-1].text == "All amounts in euros, and more" and table.cells[-1].column_span == 2


def test_reading_columns():
    spans = [sp(f"c{c} line {r} of a column", 40 + 190 * c, 700 - 14 * r - 4 * c, 150) for r in range(6) for c in range(3)]
    assert [x.text[:9] for x in structured(spans)[0]] == [f"c{c} line {r}" for c in range(3) for r in range(6)]
    short = [sp(f"c{c} line {r}", 40 + 190 * c, 700 - 14 * r - 4 * c, 150) for r in range(3) for c in range(3)]
    assert [x.text for x in structured(short)[0]][:3] == ["c0 line 0", "c1 line 0", "c2 line 0"]


def test_prose_in_two_columns_is_no_table():
    left = ["There once was a long line of", "words that went on and on", "over many rows of the page. So", "it did not end at the"]
    right = ["bottom of the first column but", "went on at the top of", "the second one as text does. It", "then came to its proper end."]
    spans = [sp(t, x, 700 - 14 * k, 200) for k, pair in enumerate(zip(left, right, strict=True)) for t, x in zip(pair, (40, 320), strict=True)]
    lines, tables, blocks = structured(spans)
    assert tables == [] and [x.text for x in lines] == left + right
    assert blocks[0].text.startswith("There once was") and "at the bottom of" in blocks[0].text


def test_blocks_in_order():
    spans = [
        sp("A title", 40, 700, 100, size=24.0), sp("1.2 Scope", 40, 660, 50), sp("Some text that goes", 40, 640, 100), sp("on in a second line.", 40, 627, 100),
        sp("• one", 40, 600, 30), sp("• two", 40, 587, 30), sp("3) three", 40, 574, 30), sp("x = 1", 40, 540, 30, family="Courier"), sp("y = 2", 52, 528, 30, family="Courier"),
        sp("The end", 40, 400, 40), sp("of it all", 40, 300, 40),
    ]
    blocks = structured(spans)[2]
    assert [(b.kind, b.level) for b in blocks[:2]] == [("heading", 1), ("heading", 4)]
    assert blocks[2].text == "Some text that goes on in a second line."
    assert [(b.ordered, [t for _, t in b.items]) for b in blocks if b.kind == "list"] == [(False, ["one", "two"]), (True, ["three"])]
    assert [b.text for b in blocks if b.kind == "preformatted"] == ["x = 1\n  y = 2"]


def test_cards_sections_definitions_and_jobs():
    cards = [s for k in range(2) for s in (sp(f"Thing {k}", 40, 700 - 60 * k, 50), sp("blue", 40, 680 - 60 * k, 30), sp(f"x {k} $3", 300, 700 - 60 * k, 30))]
    assert [(b.kind, b.items) for b in structured(cards)[2]] == [("cardList", [("Thing 0", "blue\nx 0 $3"), ("Thing 1", "blue\nx 1 $3")])]
    section = [sp("SHIP TO", 40, 700, 50), sp("Ann", 40, 680, 30), sp("Street 1", 40, 668, 30), sp("BILL TO", 240, 700, 50), sp("Bob", 240, 680, 30), sp("Road 2", 240, 668, 30)]
    found = structured(section)[2]
    assert found[0].kind == "sectionGroup" and found[0].items == [("SHIP TO", "Ann\nStreet 1"), ("BILL TO", "Bob\nRoad 2")]


def test_insets_are_marked():
    spans = [sp(f"outer line {k} with its words.", 40, 700 - 30 * k, 200) for k in range(4)]
    spans += [sp(f"inner line {k} of the note", 80, 575 - 13 * k, 150, family="Note") for k in range(4)]
    spans += [sp(f"outer line {k} with its words.", 40, 490 - 30 * k, 200) for k in range(4)]
    blocks = structured(spans)[2]
    assert [b.indent for b in blocks if b.inset is not None] == [4.0]


def test_joined_text():
    assert T.join_wrapped("exam-", "ple") == "example" and T.join_wrapped("well-known-", "x") == "well-known-x" and T.join_wrapped("a ", " b") == "a b"
    assert T.join_lines("https://example.org/abcdef", "ghi.") == "https://example.org/abcdefghi."


def test_columns_of_text_rules(spark):
    from pyspark.sql import functions as F

    rows = [("• x",), ("●x",), ("1234. x",), ("- x",), ("a. x",), (" https://a.org ",), ("https://a\x7fb",), ("ftp://a",)]
    got = spark.createDataFrame(rows, "t string").select("t", T.list_marker(F.col("t"))["text"].alias("i"), T.safe_uri(F.col("t")).alias("u")).collect()
    assert [r.i for r in got] == ["x", "x", "x", None, None, None, None, None]
    assert [r.u for r in got] == [None] * 5 + ["https://a.org", None, None]
    one = spark.createDataFrame([("a wellknown man, xwellknown",)], "t string").select(T.restore_hyphens(F.col("t"), F.array(F.lit("well-known")))).first()[0]
    assert one == "a well-known man, xwellknown"


# ------------------------------------------------------------------ files
from pagewright.plans import write  # noqa: E402


def one_page(body, extra=b"", font=None, w=None):
    w = w or write.Writer()
    w.shared += b"/Resources<</Font<</F1 %d 0 R>>%s>>" % (font or w.font(), extra)
    w.pages([write.stream(body)])
    return w


def test_object_streams_are_decoded_once(monkeypatch):
    w = write.Writer()
    w.shared += b"/Resources<</Font<</F1 %d 0 R>>>>" % w.font()
    w.pages([write.stream(write.show(40, 700, 10, write.literal(f"page {k}"))) for k in range(300)], fan=10)
    calls = []
    true = pdf.inflate
    monkeypatch.setattr(pdf, "inflate", lambda *a: calls.append(1) or true(*a))
    got = [p["spans"][0]["text"] for p in pdf.extract(w.packed(1000))]
    assert got == [f"page {k}" for k in range(300)] and len(calls) <= 4


class Counting(pdf.MemorySource):
    read_bytes = 0

    def read(self, offset, length):
        self.read_bytes += length
        return super().read(offset, length)


def test_one_page_reads_few_bytes_of_a_large_file():
    w = write.Writer()
    w.shared += b"/Resources<</Font<</F1 %d 0 R>>>>" % w.font()
    w.pages([write.stream(write.show(40, 700, 10, write.literal(f"page {k}")) + b" " * 20_000) for k in range(500)], fan=20)
    source = Counting(w.packed())
    assert source.size > 10_000_000
    [p] = pdf.extract(source, None, 443, 444)
    assert p["page"] == 444 and p["spans"][0]["text"] == "page 443"
    assert source.read_bytes < 200_000


def test_limits_start_no_recovery():
    w = one_page(b"")
    w.objects[-2] = write.flate(b" " * 50_000)
    bomb = w.table()
    with pytest.raises(pdf.PdfError) as e:
        list(pdf.extract(bomb, pdf.Limits(max_decoded_stream_bytes=10_000)))
    assert e.value.code == "RESOURCE_LIMIT"
    from pagewright.sources.fonts import CMap

    with pytest.raises(pdf.PdfError) as e:
        CMap(b"1 beginbfrange <0000> <FFFF> <0000> <0000> <0001> <0000> endbfrange")
    assert e.value.code == "RESOURCE_LIMIT"


def test_sections_first_wins_and_recovery_last_wins():
    w = one_page(write.show(10, 10, 10, b"(old)"))
    data = w.table()
    number = next(k for k, o in enumerate(w.objects, 1) if b"(old)" in o)
    at = len(data) + 1
    body = write.show(10, 10, 10, b"(new)")
    start = at + len(b"%d 0 obj\n%s\nendobj\n" % (number, write.stream(body)))
    prev = int(data.rsplit(b"startxref", 1)[1].split()[0])
    new = data + b"\n%d 0 obj\n%s\nendobj\nxref\n%d 1\n%010d 00000 n \ntrailer\n<</Size 9/Root 1 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF" % (number, write.stream(body), number, at, prev, start)
    assert texts(new) == [["new"]]
    assert texts(new.replace(b"startxref", b"startxxxx")) == [["new"]]


def test_fonts():
    from pagewright.sources import fonts

    assert [fonts.glyph_text(n) for n in ("Aacute", "one", "fi", "uni00410042", "u1F600", "G41", "C65", "f_i", "alpha", "germandbls", "x.alt", "nosuchname")] == [
        "Á", "1", "fi", "AB", "\U0001f600", "A", "A", "fi", "α", "ß", "x", None]
    assert fonts.base_encoding("StandardEncoding")[0x27] == "’" and fonts.base_encoding("MacRomanEncoding")[0x8A] == "ä"
    assert fonts.standard_widths("ABCDEF+Helvetica")["W"] == 944 and fonts.standard_widths("Courier-Bold")["i"] == 600
    c = fonts.CMap(b"1 begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange 1 beginbfrange <41> <42> [<0061> <00620063>] endbfrange")
    assert c.text == {0x41: "a", 0x42: "bc"} and c.size_at(b"A", 0) == 1 and c.size_at(b"\x81\x00", 0) == 2
    plain = b"hello"
    key, out = 55665, bytearray()
    for b in plain:
        x = b ^ key >> 8
        out.append(x)
        key = (x + key) * 52845 + 22719 & 0xFFFF
    assert fonts.type1_decrypt(bytes(out), 55665, 0) == plain


def test_spans_colours_and_paths():
    body = b"q 0.5 g /G1 gs 10 20 30 1 re f Q 1 0 0 RG 2 w 0 0 m 100 0 l S BT /F1 10 Tf 2 Tc 50 Tz 20 30 Td [(a) -1000 (b)] TJ 3 Ts (c) Tj ET BI /W 1 ID (zz) Tj \nEI BT /F1 10 Tf 900 900 Td (off) Tj ET"
    [p] = pdf.extract(one_page(body, b"/ExtGState<</G1<</ca 0.25>>>>").table())
    assert [s["text"] for s in p["spans"]] == ["a", "b", "c"]
    assert [round(s["bounds"]["x"], 3) for s in p["spans"]] == [20, 29, 33] and p["spans"][2]["bounds"]["y"] == 33
    assert p["spans"][1]["text_adjustment_before"] == -1000
    assert p["fills"][0]["color"] == "#808080" and p["fills"][0]["opacity"] == 0.25 and p["fills"][0]["points"][2] == {"x": 40.0, "y": 21.0}
    assert (p["paths"][1]["d"], p["paths"][1]["stroke"], p["paths"][1]["stroke_width"]) == ("M 0 0 L 100 0", "#ff0000", 2.0)


def test_images_shadings_and_a_damaged_tail():
    w = write.Writer()
    raw = w.add(write.stream(b"\x01\x02\x03", b"/Type/XObject/Subtype/Image/Width 1/Height 1/BitsPerComponent 8/ColorSpace/DeviceRGB"))
    jpeg = w.add(write.stream(b"\xff\xd8".hex().encode() + b">", b"/Type/XObject/Subtype/Image/Width 1/Height 1/Filter[/AHx/DCTDecode]"))
    extra = b"/XObject<</A %d 0 R/B %d 0 R>>/Shading<</S<</ShadingType 2/Function<</FunctionType 2/C0[1 0 0]/C1[0 0 1]/N 1>>>>>>" % (raw, jpeg)
    [p] = pdf.extract(one_page(b"/A Do /B Do q 5 5 50 40 re W n /S sh Q /S sh " + write.show(10, 10, 10, b"(x)") + b" (cut", extra, w=w).table())
    assert [(i["format"], i["data"]) for i in p["images"]] == [("rgb", b"\x01\x02\x03"), ("jpeg", b"\xff\xd8")]
    [shade] = p["fills"]  # inside its clip; without one nothing is painted
    assert shade["color"] == "#800080" and shade["visible"] == 2000 and p["spans"][0]["text"] == "x"


def test_truetype_widths():
    import struct

    from pagewright.sources.fonts import TrueType

    cmap = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + struct.pack(">HHHHH", 6, 14, 0, 65, 2) + struct.pack(">HH", 1, 2)
    tables = {b"cmap": cmap, b"head": bytes(18) + struct.pack(">H", 2000) + bytes(34), b"hhea": bytes(34) + struct.pack(">H", 3), b"hmtx": struct.pack(">HhHhHh", 0, 0, 1000, 0, 500, 0)}
    head, body, at = struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0), b"", 12 + 16 * len(tables)
    for tag, data in tables.items():
        head += tag + struct.pack(">III", 0, at + len(body), len(data))
        body += data
    font = TrueType(head + body)
    assert font.width("A") == 500 and font.width("AB") == 750 and font.width("z") is None


# ------------------------------------------------------------------ sources
class Answer:
    def __init__(self, status, headers, body):
        import io

        self.status, self.headers, self.body = status, headers, io.BytesIO(body)

    def read(self, n=-1):
        return self.body.read(n)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


@pytest.mark.parametrize(("ranges", "tag"), [(True, '"v1"'), (True, 'W/"v1"'), (False, None)])
def test_http_ranges(ranges, tag):
    from pagewright.sources.datasource import HttpSource

    data, asked = one_page(write.show(10, 10, 10, b"(over the net)")).table(), []

    def opener(request):
        asked.append(dict(request.header_items()))
        first, last = map(int, request.get_header("Range")[6:].split("-"))
        if ranges:
            return Answer(206, {"Content-Range": f"bytes {first}-{last}/{len(data)}", "ETag": tag}, data[first : last + 1])
        return Answer(200, {}, data)

    if ranges:
        source = HttpSource("http://x/y.pdf", opener=opener)
    else:
        with pytest.warns(UserWarning, match="does not answer ranges"):
            source = HttpSource("http://x/y.pdf", opener=opener)
    assert source.size == len(data) and [s["text"] for p in pdf.extract(source) for s in p["spans"]] == ["over the net"]
    assert ("If-range" in asked[-1]) == (tag == '"v1"')


def test_data_source_and_stream(spark, tmp_path):
    from pagewright.sources import datasource

    datasource.register(spark)
    for k in range(3):
        w = write.Writer()
        w.shared += b"/Resources<</Font<</F1 %d 0 R>>>>" % w.font()
        w.pages([write.stream(write.show(40, 700, 10, write.literal(f"file {k} page {n}"))) for n in range(1, 6)], fan=2)
        (tmp_path / f"f{k}.pdf").write_bytes(w.packed())
    (tmp_path / "g.pdf").write_bytes(b"broken")
    read = lambda **o: sorted((r.page or 0, r.spans[0].text if r.spans else r.error.code) for r in spark.read.format("pdf").options(path=str(tmp_path), **o).load().collect())
    every = [(n, f"file {k} page {n}") for n in range(1, 6) for k in range(3)]
    assert read(pagesPerPartition=2) == [(0, "INVALID_PDF"), *every]
    assert read(pages="2-3", mode="DROPMALFORMED") == [x for x in every if x[0] in (2, 3)]
    with pytest.raises(Exception, match="INVALID_PDF|no header"):
        read(mode="FAILFAST")
    found = spark.readStream.format("pdf").options(path=str(tmp_path), maxFilesPerTrigger=2).load().selectExpr("page", "spans[0].text as text", "error.code")
    q = found.writeStream.format("memory").queryName("pdf_pages").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        import time

        for _ in range(200):
            if spark.table("pdf_pages").count() >= 16:
                break
            time.sleep(0.2)
    finally:
        q.stop()
    assert sorted((r.page or 0, r.text or r.code) for r in spark.table("pdf_pages").collect()) == [(0, "INVALID_PDF"), *every]


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf_bytes([[(40, 700, 10, "one")], [(40, 700, 10, "two")]]))
    got = pdf.read_pages(spark, str(tmp_path / "*.pdf")).selectExpr("page", "spans[0].text t").orderBy("page").collect()
    assert [tuple(r) for r in got] == [(1, "one"), (2, "two")]


def test_streaming_furniture_equals_the_window(spark, tmp_path):
    from pyspark.sql import functions as F

    from pagewright.operators import document
    from pagewright.streaming import furniture

    pages = [("a", p, 0, f"Report page {p}" if p != 4 else "Other", True) for p in range(1, 9)] + [("a", p, 1, f"body {p}", False) for p in range(1, 9)]
    pages += [("b", p, 0, "Once" if p == 1 else f"Twice {p}" if p in (2, 5) else f"x{'y' * p}", True) for p in range(1, 7)]
    schema = "doc_id string, page int, line_seq int, text string, margin boolean"
    for k in range(1, 9):
        spark.createDataFrame([r for r in pages if r[1] == k], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    spark.createDataFrame([("a", None, None, None, None), ("b", None, None, None, None)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "b9"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    q = furniture.suppressed(stream).writeStream.format("memory").queryName("furniture").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("furniture").collect())
    batch = spark.createDataFrame(pages, schema)
    told = document.repeated_furniture(batch.where("margin").withColumn("signature", T.furniture_signature(F.col("text"))))
    want = {(r.doc_id, r.page, r.line_seq): r.suppressed for r in told.collect()}
    assert got == sorted((d, p, n, t, want.get((d, p, n), False)) for d, p, n, t, _ in pages)


def test_diffs_and_longest_common_order(spark):
    from pyspark.sql import functions as F

    from pagewright.operators import verify

    one = spark.createDataFrame([(["a", "b", "c", "d"], ["b", "x", "d", "a"]), ([], ["a"])], "e array<string>, a array<string>")
    assert [r[0] for r in one.select(verify.longest_common(F.col("e"), F.col("a"))).collect()] == [2, 0]


def test_markdown_tables_split_at_full_rows(spark):
    from pyspark.sql import functions as F

    from pagewright.operators import document, page

    row = lambda md, full=False: (f"<tr>{md}</tr>", md, full, [md])
    table = ([0.0, 1.0], ["h", "k"], ["h", "k"], "Cap", True, False, [row("| h | k |"), row("| 1 | 2 |"), row("_all_", True), row("| 3 | 4 |")])
    df = spark.createDataFrame([([table],)], f"tables array<{page.TABLE}>")
    assert df.select(document.table_markdown(F.col("tables"))).first()[0] == "**Cap**\n\n| h | k |\n| --- | --- |\n| 1 | 2 |\n\n_all_\n\n| h | k |\n| --- | --- |\n| 3 | 4 |\n\n"
    assert df.select(document.table_html(F.col("tables"))).first()[0].startswith("<table><caption>Cap</caption><thead><tr>| h | k |</tr></thead><tbody>")


def test_structure_helpers(spark):
    from pyspark.sql import functions as F

    from pagewright.operators import structure

    boxes = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 1.0), (1, 5.0, 3.0, 1.0, 1.0)], "k int, x double, y double, width double, height double")
    assert tuple(structure.union_box(boxes, ["k"]).first()) == (1, 0.0, 0.0, 6.0, 4.0)
    turned = boxes.select(structure.rotated(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.lit(90), F.lit(10.0), F.lit(20.0)).alias("r")).collect()
    assert [tuple(r.r) for r in turned] == [(0.0, 8.0, 1.0, 2.0), (3.0, 4.0, 1.0, 1.0)]
    colours = spark.createDataFrame([(1, "#1", 3, 0), (1, "#2", 2, 1), (1, "#2", 1, 2)], "k int, color string, n int, seq int")
    assert tuple(structure.weighted_mode(colours, ["k"], "color", F.col("n"), "seq").first()) == (1, "#1")
    spans = spark.createDataFrame([(1, 0, 10.0, 10.0, 20.0, 10.0, 10.0), (1, 1, 100.0, 10.0, 20.0, 10.0, 10.0)], "page int, seq int, x double, y double, width double, height double, size double")
    links = spark.createDataFrame([(1, 0, "a", 5.0, 5.0, 40.0, 20.0), (1, 1, "b", 5.0, 5.0, 40.0, 20.0)], "page int, annot_seq int, href string, lx double, ly double, lw double, lh double")
    assert sorted((r.seq, r.href) for r in structure.linked_spans(spans, links, ["page"]).collect()) == [(0, "b"), (1, None)]


# ------------------------------------------------------------------ media
from pagewright.operators import media as M  # noqa: E402


def test_png_of_samples():
    import struct

    raw = bytes(range(18))
    data = M.png(3, 2, raw)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (3, 2)
    at = data.index(b"IDAT")
    n = struct.unpack(">I", data[at - 4 : at])[0]
    assert zlib.decompress(data[at + 4 : at + 4 + n]) == b"\0" + raw[:9] + b"\0" + raw[9:]


def test_media_touch_and_backdrops_stay_alone():
    image = lambda x, y, w, h: {"width": 1, "height": 1, "format": "rgb", "data": b"abc", "transform": [w, 0, 0, h, x, y], "opacity": 1.0}
    held = M.media_of(600, 800, [], [], [image(0, 0, 600, 800), image(10, 10, 50, 50), image(61, 12, 50, 50), image(300, 300, 50, 50)])
    assert sorted(len(m.parts) for m in held) == [1, 1, 2]
    assert [n for n, _, _ in M.files_of(held[-1], 1, 3, 800)] and M.touch(P.Box(0, 0, 10, 10), P.Box(11, 0, 10, 10)) and not M.touch(P.Box(0, 0, 10, 10), P.Box(13, 0, 10, 10))
    white = {"points": [{"x": x, "y": y} for x, y in ((0, 0), (600, 0), (600, 800), (0, 800))], "color": "#FFFFFF", "opacity": 1.0}
    assert M.drawings(600, 800, [white], []) == []
    assert "script" not in M.svg(M.Media(P.Box(0, 0, 1, 1), "vector", [("path", {"d": "M 0 0<script>"})]), 10)


def test_one_caption_for_one_picture():
    body = [P.as_line([sp(f"Some words of the body, line {k}.", 50, 700 - 13 * k, 300)]) for k in range(5)]
    caption = P.as_line([sp("Figure 1", 100, 385, 120, size=8.0, family="Cap")])
    far = P.as_line([sp("A later text", 100, 200, 120)])
    blocks = [P.Block("paragraph", x.text, lines=[x]) for x in (*body, caption, far)]
    held = [M.Media(P.Box(90, 400, 140, 100), "raster")]
    M.attach_captions(held, blocks, 600, 800, [*body, caption, far])
    assert held[0].caption == "Figure 1"


def test_scripts():
    s = lambda t, x: {"text": t, "bounds": {"x": float(x), "y": 10.0, "width": 10.0, "height": 10.0}, "font_size": 10.0, "direction": "ltr"}
    assert [x["text"] for x in M.in_script_order([s("םלוע", 10), s(" ", 20), s("םולש", 30)])] == ["שלום", " ", "עולם"]
    assert [x["text"] for x in M.in_script_order([s("سلام"[::-1], 10), s("ab", 20)])][0] == "سلام"
    assert [x["text"] for x in M.in_script_order([s("abc", 10), s("ם", 20)])] == ["abc", "ם"]
    assert M.citation(") אב12(גד()34הו") == "הו34(גד)(12) אב"


def test_coalesced_spans():
    s = lambda t, x, w, **k: {"text": t, "bounds": {"x": x, "y": 0.0, "width": w, "height": 10.0}, "font_size": 10.0, "direction": "ltr", "color": "#000000"} | k
    assert [x["text"] for x in M.coalesced([s("a", 0.0, 5.0), s("b", 5.0, 5.0), s("c", 12.0, 5.0), s("d", 17.0, 5.0, color="#ff0000"), s("e", 22.0, 5.0, has_leading_space=True)])] == ["ab", "c", "d", "e"]
    assert [M.fallback_family(f) for f in ("Courier", "Times New Roman", "Arial")] == ["monospace", "serif", "sans-serif"]


def test_type1_widths():
    from pagewright.sources.fonts import Type1

    def lock(plain, key):
        out = bytearray()
        for b in plain:
            x = b ^ key >> 8
            out.append(x)
            key = (x + key) * 52845 + 22719 & 0xFFFF
        return bytes(out)

    number = lambda n: bytes([n + 139]) if abs(n) <= 107 else bytes([247 + (n - 108) // 256, (n - 108) % 256])
    glyph = lambda name, w: b"/%s %d RD " % (name, 4 + len(number(0) + number(w)) + 1) + lock(b"0000" + number(0) + number(w) + bytes([13]), 4330) + b" ND\n"
    private = b"0000dup /Private 8 dict /lenIV 4 def 2 index /CharStrings 2 dict dup begin\n" + glyph(b"A", 722) + glyph(b"space", 50) + b"end"
    program = b"%!PS-AdobeFont-1.0\ncurrentfile eexec\n" + lock(private, 55665)
    assert Type1(program).widths == {"A": 722.0, "space": 50.0}
    assert Type1(b"x eexec " + lock(private, 55665).hex().encode()).widths == {"A": 722.0, "space": 50.0}


def test_html_files(spark):
    from pagewright.operators import document

    got = document.html_files(spark.createDataFrame([("a", "<p>x</p>", "A & B")], "doc_id string, text string, title string"), language="de", styles=False).first().text
    assert got == '<!doctype html><html lang="de"><head><meta charset="utf-8"><title>A &amp; B</title></head><body><p>x</p></body></html>'
