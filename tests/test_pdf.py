import struct
import zlib

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from docgrain.sources import content, fonts, pdf, tiff
from docgrain.sources.pdfvalues import Hex, Keyword, Name, ParseError, Reader, Ref, Text, find_all, number_text, plain_string, reduced, to_bytes

LEAF = st.none() | st.booleans() | st.integers(-10**6, 10**6).map(float) | st.text("abZ #/()é", max_size=6).map(Name) | st.binary(max_size=12).map(Text) | st.binary(max_size=6).map(Hex) | st.tuples(st.integers(1, 99), st.integers(0, 3)).map(lambda x: Ref(*x))
VALUE = st.recursive(LEAF, lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text("abc", min_size=1, max_size=3), v, max_size=4), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(VALUE)
def test_values_round_trip(value):
    r = Reader(to_bytes(value))
    assert r.value() == value and r.ended()


def test_syntax():
    read = lambda b: Reader(b).value()
    assert read(b"<</A 1/A 2>>") == {"A": 2.0} and read(b"[1 0 R 1 0 RG]") == [Ref(1, 0), 1.0, 0.0, Keyword("RG")]
    assert read(b"(a(b)\\)\\101\\\r\nc\r\nd)") == b"a(b))Ac\nd" and read(b"< 4E6 >") == bytes((0x4E, 0x60))
    assert read(b"/A#20B") == "A B" and read(b"+.5") == 0.5 and read(b"4.") == 4.0 and read(b"% note\n7") == 7.0
    for bad in (b"(", b"<4", b"<</A", b"[1", b"", b")", b"[" * 500):
        with pytest.raises(ParseError):
            read(bad)
    assert to_bytes([1.0, Name("a"), Text(b"x"), 2.0, 3.0, Ref(1, 0)]) == b"[1/a(x)2 3 1 0 R]"
    assert [number_text(x) for x in (0.5, -0.25, 3.0, -0.0000001, 100.10, 1e6)] == [b".5", b"-.25", b"3", b"0", b"100.1", b"1000000"]
    assert reduced({"Matrix": [0.1234567], "W": [0.1234567]}) == {"Matrix": [0.123457], "W": [0.1235]}
    assert plain_string(Hex(b"\xfe\xff\0A\0\xe9")) == b"A\xe9" and plain_string(Hex(b"\xfe\xff\x20\xac")) == b"\xa0" and plain_string(Hex(b"\xfe\xff\x4e\x2d")) == b"\xfe\xff\x4e\x2d"
    assert list(find_all({"a": [1.0, {"b": 2.0}]}, lambda v: isinstance(v, dict) and "b" in v)) == [{"b": 2.0}]


def sample(text=b"BT (Hello) Tj ET"):
    inner = b"<</Title(T)>> [7 0 R]"
    packed = b"10 0 11 13 " + inner
    small, objs = zlib.compress(text), zlib.compress(packed)
    out = b"%PDF-1.5\n%\xe2\xe3\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj<</Kids[3 0 R]/Type/Pages>>endobj\n"
    out += b"3 0 obj<</Type/Page/Parent 2 0 R/Contents[4 0 R 5 0 R]>>endobj\n"
    for n in (4, 5):
        out += b"%d 0 obj<</Filter/FlateDecode/Length %d>>stream\r\n" % (n, len(small)) + small + b"\nendstream endobj\n"
    out += b"6 0 obj<</Type/ObjStm/N 2/First 11/Filter/FlateDecode/Length 99 0 R>>stream\n" + objs + b"\nendstream\nendobj\n"
    out += b"8 0 obj (old) endobj 8 0 obj (new) endobj\n"
    out += b"xref\n0 1\n0000000000 65535 f\r\ntrailer<</Root 1 0 R/Size 9>>\nstartxref\n9\n%%EOF\n"
    return out


@pytest.fixture(scope="module")
def table(spark):
    files = spark.createDataFrame([("a.pdf", bytearray(sample())), ("b.pdf", bytearray(b"%PDF-1.4\n1 0 obj <<\n junk 2 0 obj 5 endobj")), ("empty.pdf", bytearray(b""))], "path string, content binary")
    return pdf.objects(files).cache()


def test_objects(table):
    rows = {(r["path"], r["num"], r["pos"]): r for r in table.collect()}
    a = [r for r in rows.values() if r["path"] == "a.pdf"]
    assert [r["kind"] for r in sorted(a, key=lambda r: r["pos"])] == ["version", "comment", "object", "object", "object", "stream", "stream", "objstm", "object", "object", "object", "object", "xreftable", "trailer", "startxref", "eof"]
    assert {r["container"] for r in a if r["num"] in (10, 11)} == {6}
    b = sorted((r for r in rows.values() if r["path"] == "b.pdf"), key=lambda r: r["pos"])
    assert [r["kind"] for r in b] == ["version", "error", "object"] and "ParseError" in b[1]["error"]
    last = {r["num"]: bytes(r["body"]) for r in pdf.latest(table).where("path = 'a.pdf'").collect()}
    assert last[8] == b"(new)"


def test_queries_on_objects(table, spark):
    got = {r["path"]: r for r in pdf.extract(table, 4).collect()}
    assert bytes(got["a.pdf"]["data"]) == b"BT (Hello) Tj ET" and got["b.pdf"]["error"] == "object not found"
    assert pdf.extract(table, 3).where("path = 'a.pdf'").first()["error"] == "object has no stream"
    marked = {r["num"]: r["is_duplicate"] for r in pdf.hashes(table).collect()}
    assert marked[4] is False and marked[5] is True
    assert {r["num"] for r in pdf.used(table).collect()} == {1, 2, 3, 4, 5}
    text = pdf.get(table, 3).where("path = 'a.pdf'").first()["text"]
    assert "/Contents [<<" in text and "/Parent 2 0 R" in text
    sizes = spark.createDataFrame([("a.pdf", 1000), ("empty.pdf", 0)], "path string, length long")
    s = {r["path"]: r for r in pdf.stat(table, sizes).collect()}
    assert s["a.pdf"]["vector_count"] == 2 and s["a.pdf"]["objstm_count"] == 1 and 0 < s["a.pdf"]["structures"] < 1000 and s["empty.pdf"]["structures"] == 0
    assert pdf.info(table).where("category = 'vector'").count() == 2
    assert pdf.as_json(table).where("num = 1 and path = 'a.pdf'").selectExpr("get_json_object(json, '$.Type') as t").first()["t"] == "/Catalog"
    assert pdf.duplicates(table).first()["n"] == 2


def test_optimize_and_assemble(table, spark):
    done = pdf.optimize(table.where("path = 'a.pdf'"))
    kept = {r["num"]: bytes(r["body"]) for r in done.collect()}
    assert set(kept) == {1, 2, 3, 4} and kept[3] == b"<</Contents[4 0 R 4 0 R]/Parent 2 0 R/Type/Page>>"
    whole = pdf.assemble(done, table.where("path = 'a.pdf'"))
    again = pdf.objects(whole)
    assert again.where("kind = 'error'").count() == 0
    assert bytes(pdf.extract(again, 4).first()["data"]) == b"BT(Hello)Tj ET"
    raw = bytes(whole.first()["content"])
    assert b"xref\n0 5\n" in raw and raw[int(raw.split(b"startxref\n")[1].split()[0]) :].startswith(b"xref")


def ops(data):
    return content.write(content.optimized(content.parse(data)))


def test_content_rewrites():
    assert ops(b"q 1 0 0 1 0 0 cm q 2 w 2 w 0 0 m 10 0 l 10 5 l 0 5 l h S Q Q") == b"q 2 w 0 0 10 5 re S Q"
    assert ops(b"BT /F 12 Tf (a) Tj <62> Tj [(c) -5 (d)] TJ ET") == b"BT/F 12 Tf[(abc)-5(d)]TJ ET"
    assert ops(b".5 .5 .5 rg 0 0 0 .25 K 0 0 m 9 9 l S") == b".5 g .75 G 0 0 m 9 9 l S"
    assert ops(b"0 0 m 5 5 l 10 10 l 20 10 l h S") == b"0 0 m 10 10 l 20 10 l s"
    assert ops(b"1 0 0 1 2 3 cm 2 0 0 2 0 0 cm 0 0 m 1 1 l S") == b"2 0 0 2 2 3 cm 0 0 m 1 1 l S"
    assert ops(b"q 5 w Q BT ET 0 0 m 1 1 l S") == b"0 0 m 1 1 l S"
    assert ops(b"1 w 1 w 3 w 0 0 m 1 1 l S 3 w 0 0 m 2 2 l S") == b"3 w 0 0 m 1 1 l S 0 0 m 2 2 l S"
    assert ops(b"/P <</M 1>> BDC EMC") == b"/P<</M 1>>BDC EMC"


def test_content_parts():
    program = content.parse(b"q BI /Width 2 /CS /G ID \x01\x02 EI Q % note\n/Im Do /Fm Do (x) '")
    assert [c.op for c in program] == ["q", "BI", "Q", "Do", "Do", "'"] and program[1].args[1] == b"\x01\x02"
    assert content.write(program) == b"q BI/CS/G/W 2 ID \x01\x02\nEI Q/Im Do/Fm Do(x)'"
    assert content.resources_used(program) == [("XObject", "Fm"), ("XObject", "Im")]
    assert content.write(content.renamed(program[3:5], {("XObject", "Im"): "A"})) == b"/A Do/Fm Do"
    assert content.human(content.parse(b"q BT (a) Tj ET Q")) == "q\n  BT\n    (a) Tj\n  ET\nQ"
    assert [content.CATEGORY[x] for x in ("q", "Td", "f*", "EMC")] == ["general", "text state", "paint", "marked"] and sum(map(len, (v.split() for v in content.CATEGORIES.values()))) == 73
    data = b"0.001 0.002 m 0.003 0.004 l S"
    assert len(content.shortest(data)) <= len(data)


def test_commands_table(table):
    d = pdf.with_data(table.where("kind = 'stream' and path = 'a.pdf' and num = 4"))
    got = content.commands(d).orderBy("seq").collect()
    assert [(r["op"], r["category"], r["params"]) for r in got] == [("BT", "text object", []), ("Tj", "text", ["(Hello)"]), ("ET", "text object", [])]


def test_fonts(spark):
    tables = [fonts.Table("glyf", 0, 0, b"abcde"), fonts.Table("DSIG", 0, 0, b"1234"), fonts.Table("head", 0, 0, struct.pack(">iiIIHHqqhhhhHHhhh", 65536, 98304, 0, 0x5F0F3CF5, 0, 1000, 0, 0, -1, -2, 3, 4, 0, 8, 2, 1, 0))]
    data = fonts.build(fonts.SCALERS[0], tables)
    scaler, back = fonts.parse(data)
    assert scaler == fonts.SCALERS[0] and [t.tag for t in back] == ["DSIG", "glyf", "head"] and back[1].data == b"abcde" and all(t.offset % 4 == 0 for t in back)
    assert [t.tag for t in fonts.without(back)] == ["glyf", "head"]
    assert fonts.head(back[2].data)["revision"] == 1.5 and fonts.head(back[2].data)["long_locations"] == 1
    assert fonts.locations(struct.pack(">3H", 0, 2, 5), False, 2) == [0, 4, 10] and fonts.slices([0, 4, 10]) == [(0, 4), (4, 6)]
    assert fonts.checksum(b"\0\0\0\1\0\0\0\2\1") == 0x01000003 and fonts.glyph(b"") == {"kind": "empty"}
    df = spark.createDataFrame([("f", 1, bytearray(data)), ("g", 2, bytearray(b"no"))], "path string, num long, data binary")
    assert [r["tag"] for r in fonts.font_tables(df).where("computed = checksum").orderBy("tag").collect()] == ["DSIG", "glyf", "head"]
    with pytest.raises(ValueError):
        fonts.parse(b"\0" * 20)


def test_tiff():
    data = tiff.simple_tiff(2, 1, "rgb", b"abcdef")
    assert data[:4] == b"II*\0" and data.endswith(b"abcdef") and struct.unpack_from("<H", data, 8) == (12,)
    assert tiff.simple_tiff(1, 1, "lab", b"abc") == b""


def test_compact_files_read_back(table, spark):
    own = table.where("path = 'a.pdf'")
    done = pdf.optimize(own)
    whole = pdf.assemble(done, own, compact=True)
    again = pdf.objects(whole)
    assert again.where("kind = 'error'").count() == 0 and {r["kind"] for r in again.collect()} >= {"objstm", "xref", "stream", "object"}
    before = {r["num"]: bytes(r["body"]) for r in done.where("stream is null").collect()}
    inside = {r["num"]: bytes(r["body"]) for r in again.where("container is not null").collect()}
    assert inside == before
    raw = bytes(whole.first()["content"])
    at = int(raw.split(b"startxref\n")[1].split()[0])
    xref = again.where("kind = 'xref'").first()
    assert xref["offset"] == at
    d = Reader(bytes(xref["body"])).value()
    rows = pdf.unfiltered(d, bytes(xref["stream"]))[0]
    widths = [int(w) for w in d["W"]]
    entries = [rows[i : i + sum(widths)] for i in range(0, len(rows), sum(widths))]
    assert len(entries) == int(d["Size"]) and d["Root"] == Ref(1, 0)
    places = {r["num"]: r["offset"] for r in again.where("container is null and num is not null").collect()}
    for n, e in enumerate(entries):
        if e[0] == 1:
            assert int.from_bytes(e[1 : 1 + widths[1]], "big") == places[n]
        assert e[0] == (2 if n in inside else 1 if n in places else 0)


def test_pages_get_one_content_stream(spark):
    row = lambda path, num, body, stream=None: (path, num, num, 0, "object" if stream is None else "stream", b"Page".decode() if b"/Type/Page" in body else None, None, body, stream)
    schema = "path string, pos long, num long, gen long, kind string, type string, subtype string, body binary, stream binary"
    rows = [
        row("f", 1, b"<</Contents[2 0 R 3 0 R 2 0 R]/Type/Page>>"), row("f", 2, b"<</Length 1>>", b"q"), row("f", 3, b"<</Filter/ASCIIHexDecode/Length 3>>", b"51>"),
        row("f", 5, b"<</Contents[2 0 R 4 0 R]/Type/Page>>"), row("f", 6, b"<</Contents 2 0 R/Type/Page>>"), row("f", 7, b"<</Contents[3 0 R 3 0 R]/Type/Page>>"),
        row("g", 1, b"<</Contents[2 0 R]/Type/Page>>"), row("g", 2, b"<</Length 1>>", b"q"),
    ]
    got = {(r["path"], r["num"]): (bytes(r["body"]), r["stream"] and bytes(r["stream"])) for r in pdf.merged_contents(spark.createDataFrame(rows, schema)).collect()}
    assert got["f", 8] == (b"<</Length 6>>", b" q Q q") and got["f", 9] == (b"<</Length 4>>", b" Q Q")
    assert got["f", 1][0] == b"<</Contents 8 0 R/Type/Page>>" and got["f", 7][0] == b"<</Contents 9 0 R/Type/Page>>"
    assert len(got) == 10 and all(got[r[0], r[2]][0] == r[7] for r in rows if (r[0], r[2]) not in {("f", 1), ("f", 7)})


def test_predicates_shapes_masks_and_new_objects(table, spark):
    own = table.where("path = 'a.pdf'")
    shapes = {r["path"]: (r["is_empty"], r["has_version"]) for r in pdf.shape(table).collect()}
    assert shapes["a.pdf"] == (False, True)
    parts = pdf.partition(own)
    assert parts["streams"].where("stream is null").count() == 0 and parts["plain"].where("stream is not null or num is null").count() == 0
    assert own.where(pdf.is_catalog()).count() == 1 and own.where(pdf.is_info()).count() == own.where(F.contains("body", F.lit(bytearray(b"/Author")))).count()
    assert own.where(pdf.has_content() & ~pdf.optimizable()).count() <= own.where("stream is not null").count()
    masked = spark.createDataFrame([("m", 1, b"<</SMask 7 0 R/X<</SMask 8 0 R>>>>"), ("m", 2, b"<</SMask/None>>")], "path string, num long, body binary")
    assert sorted(r["num"] for r in pdf.masks(masked).collect()) == [7, 8]
    objects = spark.createDataFrame([("a", 3, 0, "object", b"1", None), ("b", 9, 0, "object", b"2", None)], "path string, num long, gen long, kind string, body binary, stream binary")
    more = spark.createDataFrame([("a", b"x", None, 1), ("a", b"y", b"s", 2), ("b", b"z", None, 1)], "path string, body binary, stream binary, at int")
    assert sorted((r["path"], r["num"], bytes(r["body"]), r["kind"]) for r in pdf.put_new(objects, more, ["at"]).collect()) == [("a", 3, b"1", "object"), ("a", 4, b"x", "object"), ("a", 5, b"y", "stream"), ("b", 9, b"2", "object"), ("b", 10, b"z", "object")]
    assert sorted((r["num"], bytes(r["body"])) for r in pdf.put(objects, objects.withColumn("body", F.lit(b"new")).where("num = 9")).collect()) == [(3, b"1"), (9, b"new")]


def test_marks_and_text_matrices():
    assert ops(b"/P <</M 1>> BDC /P <</M 1>> BDC 0 0 m 1 1 l S EMC EMC") == b"/P<</M 1>>BDC 0 0 m 1 1 l S EMC"
    assert ops(b"/P <</M 1>> BDC /P <</M 2>> BDC 0 0 m 1 1 l S EMC EMC") == b"/P<</M 1>>BDC/P<</M 2>>BDC 0 0 m 1 1 l S EMC EMC"
    assert ops(b"BT /F 9 Tf 2 0 0 2 10 700 Tm (a) Tj 2 0 0 2 10 690 Tm (b) Tj ET") == b"BT/F 9 Tf 2 0 0 2 10 700 Tm(a)Tj 0 -5 Td(b)Tj ET"
    assert b"Td" not in ops(b"BT /F 9 Tf 2 0 0 2 10 700 Tm (a) Tj T* 2 0 0 2 10 690 Tm (b) Tj ET")


def test_glyph_outlines_and_hints():
    # One byte up, one byte down, two bytes, and the same as before.
    flags = bytes([1 | 2 | 16 | 4 | 32, 2 | 4, 1 | 32, 1 | 16 | 32])
    simple = struct.pack(">5hHH", 1, 0, 0, 9, 9, 3, 2) + b"hh" + flags + b"\x05\x02" + struct.pack(">h", -300) + b"\x07\x03"
    got = fonts.outline(simple)
    assert got["points"] == [(5, 7, True), (3, 4, False), (-297, 4, True), (-297, 4, True)] and got["hints"] == b"hh" and got["ends"] == [3]
    bare = fonts.without_hints(simple)
    assert len(bare) == len(simple) - 2 and fonts.outline(bare) == got | {"hints": b""} and fonts.without_hints(bare) == bare
    composite = struct.pack(">5h", -1, 0, 0, 9, 9) + struct.pack(">HHbb", 32, 4, 1, 1) + struct.pack(">HHhhh", 1 | 8 | 256, 5, 1, 1, 2) + struct.pack(">H", 3) + b"abc"
    bare = fonts.without_hints(composite)
    assert bare == composite[:16] + struct.pack(">HHhhh", 1 | 8, 5, 1, 1, 2) and fonts.outline(composite)["points"] == []
    assert fonts.without_hints(b"") == b"" and fonts.flags_at(b"\x09\x02\x01", 0, 4) == ([9, 9, 9, 1], 3)


def test_fonts_without_hints_have_their_locations_anew():
    a = struct.pack(">5hHH", 1, 0, 0, 9, 9, 0, 3) + b"hhh" + bytes([1 | 16 | 32])
    head = struct.pack(">iiIIHHqqhhhhHHhhh", 65536, 65536, 0, 0x5F0F3CF5, 0, 1000, 0, 0, 0, 0, 0, 0, 0, 8, 2, 1, 0)
    tables = [fonts.Table("glyf", 0, 0, a + a), fonts.Table("loca", 0, 0, struct.pack(">4I", 0, len(a), len(a), 2 * len(a))), fonts.Table("head", 0, 0, head), fonts.Table("maxp", 0, 0, struct.pack(">IH", 65536, 3))]
    now = {t.tag: t.data for t in fonts.unhinted(tables)}
    assert fonts.head(now["head"])["long_locations"] == 0
    spans = fonts.slices(fonts.locations(now["loca"], False, 3))
    assert [n for _, n in spans] == [16, 0, 16] and all(fonts.outline(now["glyf"][o : o + n])["points"] == [(0, 0, True)] for o, n in spans if n)
    assert fonts.unhinted(tables[:1]) == tables[:1]
    assert fonts.relocated([b"x" * 140_000])[2] is True


def test_resources_and_text_states():
    program = content.parse(b"/G gs BT /F 9 Tf 50 Tz 2 0 0 2 1 1 Tm 3 4 Td (x) Tj ET q 2 0 0 2 0 0 cm 1 0 0 1 5 5 cm Q /X Do")
    used = set(content.resources_used(program))
    kept = content.kept_resources({"Font": {"F": 1, "H": 2}, "ExtGState": {"G": 3}, "Pattern": {"P": 4}, "ProcSet": [1]}, used)
    assert kept == {"Font": {"F": 1}, "ExtGState": {"G": 3}, "ProcSet": [1]}
    states = dict(zip([c.op for c in program], content.text_scales(program)))
    assert states["Tj"] == (content.IDENTITY, (2, 0, 0, 2, 7, 9), 0.5)
    assert states["Q"][0] == (2, 0, 0, 2, 10, 10) and states["Do"][0] == content.IDENTITY


def test_files_go_through_a_task_one_after_another(spark):
    rows = [(f"f{i % 700}", n, 0, b"[%d 0 R]" % i if n != 2 else b"<</R %d 0 R>>" % i, b"s" * i if n == 2 else None) for i in range(700) for n in (3, 1, 2)]
    objects = spark.createDataFrame(rows, "path string, num long, gen long, body binary, stream binary")
    trailers = objects.select("path", F.lit("trailer").alias("kind"), F.lit(0).alias("pos"), F.lit(b"<</Root 1 0 R>>").alias("body")).distinct()
    together = objects.groupBy("path").agg(F.collect_list(F.struct("stream", "num", "gen", "body")).alias("objects")).withColumn("trailer", F.lit(b"<</Root 1 0 R>>"))
    for compact in (False, True):
        dealt = pdf.assemble(objects, trailers, compact)
        assert "FlatMapGroupsInPandas" not in dealt._jdf.queryExecution().toString()
        files = {r["path"]: bytes(r["content"]) for r in dealt.collect()}
        assert len(files) == 700 and files == {r["path"]: bytes(r["content"]) for r in pdf.assembled(together, compact).collect()}
        again = pdf.objects(spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "path string, content binary"))
        if not compact:
            assert files == {r["path"]: bytes(r["content"]) for r in pdf.assemble(again).collect()}
        assert {(r["path"], r["num"]): bytes(r["body"]) for r in again.where("kind in ('object', 'stream')").collect()} == {(p, n): b for p, n, _, b, _ in rows}
        texts = {r["path"]: r["text"] for r in pdf.get(again, 1).where("path not in ('f4', 'f5')").collect()}
        assert texts == {f"f{i}": {2: "[<<\n    /R 2 0 R\n  >>]", 3: "[[3 0 R]]"}.get(i, f"[{i} 0 R]") for i in range(700) if i not in (4, 5)}


def test_get_reads_files_once_and_writes_nothing(spark):
    table = pdf.objects(spark.createDataFrame([("a.pdf", bytearray(sample())), ("none.pdf", bytearray(b"%PDF-1.4\n2 0 obj 5 endobj"))], "path string, content binary"))
    got = pdf.get(table, 8)
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and plan.count("step-") == 0
    assert [(r["path"], r["text"]) for r in got.collect()] == [("a.pdf", "(new)")]


def test_short_objects_are_read_as_long_ones(monkeypatch):
    odd = b"1 0 obj (endobj) endobj 2 0 obj <</A/stream>> endobj 3 0 obj % endobj\n7 endobj 4 0 obj endobj 5 0 obj <</Length 1>>stream\nx\nendstream endobj 6 0 obj [1 0 R<</B 2 0 R>>]endobj trailer<</Root 1 0 R>>startxref 5 8 0 obj null"
    for data in (sample(), odd, sample()[:-60]):
        short = pdf.parse(data)
        with monkeypatch.context() as m:
            m.setattr(pdf, "short_value", lambda *_: None)
            m.setattr(pdf, "SHORT", 0)
            assert pdf.parse(data) == short
    assert [bytes(r["body"]) for r in pdf.parse(odd) if r["num"]] == [b"(endobj)", b"<</A/stream>>", b"7", b"null", b"<</Length 1>>", b"[1 0 R<</B 2 0 R>>]", b"null"]


def test_documents_have_their_text_in_a_plain_stream_too(spark, sf_dir):
    from docgrain.plans import catalogue

    texts = {f"doc-{r['doc_id']}": r["text"].encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    again = pdf.objects(catalogue.document_files(spark, sf_dir, plain=True)).where("num in (4, 5)")
    got = {(r["path"], r["num"]): (r["filters"], bytes(r["stream"])) for r in again.collect()}
    assert len(got) == 2 * len(texts) and all(got[p, 5] == ([], t) and got[p, 4][0] == ["FlateDecode"] for p, t in texts.items())


def test_optimize_gathers_files_once_and_writes_nothing(spark):
    small = zlib.compress(b"q 0 0 m 1 1 l S Q")
    streams = [b"%d 0 obj<</Filter/FlateDecode/Length %d 0 R>>stream\n" % (n, 9) + small + b"\nendstream endobj\n" for n in (4, 5)]
    data = b"%PDF-1.5\n1 0 obj<</Type/Catalog/P 3 0 R>>endobj 3 0 obj<</Contents[5 0 R 4 0 R 8 0 R]>>endobj\n" + b"".join(streams)
    data += b"8 0 obj 1 endobj 8 0 obj[6 0 R]endobj 6 0 obj<</T<41>>>endobj 7 0 obj 7 endobj 9 0 obj %d endobj trailer<</Root 1 0 R>>startxref" % len(small)
    done = pdf.optimize(pdf.objects(spark.createDataFrame([(f"f{i}", bytearray(data)) for i in range(50)], "path string, content binary")))
    plan = done._jdf.queryExecution().toString()
    assert "step-" not in plan and "Join" not in plan
    got = {(r["path"], r["num"]): bytes(r["body"]) for r in done.collect()}
    assert {k for k in got if k[0] == "f7"} == {("f7", n) for n in (1, 3, 4, 6, 8)} and len(got) == 250
    assert got["f7", 3] == b"<</Contents[4 0 R 4 0 R 8 0 R]>>" and got["f7", 8] == b"[6 0 R]" and got["f7", 6] == b"<</T(A)>>" and b"9 0 R" not in got["f7", 4]


def test_words_of_content_are_read_at_once():
    program = content.parse(b"a true b % c\n1 d BI /W 2 ID xy EI null 3rd -e (f) g")
    assert [(c.op, c.args) for c in program] == [("a", ()), ("b", (True,)), ("d", (1.0,)), ("BI", ({"W": 2.0}, b"xy")), ("rd", (None, 3.0)), ("-e", ()), ("g", (b"f",))]
    assert content.bare(b"a") is content.parse(b"a")[0] and content.write(content.parse(b"a  b\n(c) d")) == b"a b(c)d"
