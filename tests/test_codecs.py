import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docgrain.functions import codecs as C
from docgrain.functions import predictors as P

DATA = st.binary(max_size=300) | st.lists(st.sampled_from([0, 0, 0, 255]), max_size=600).map(bytes)


@settings(max_examples=120, deadline=None)
@given(DATA)
@pytest.mark.parametrize("codec", sorted(C.ENCODERS))
def test_round_trips(codec, data):
    assert C.DECODERS[codec](C.ENCODERS[codec](data)) == data


def test_known_forms():
    assert C.rle_encode(b"aaaabc") == bytes((253, 97, 1)) + b"bc" and C.rle_encode(b"") == b""
    assert C.rle_decode(bytes((2,)) + b"abc" + bytes((254,)) + b"x" + bytes((128, 9))) == b"abcxxx"
    assert C.rle_encode(b"a" * 200) == bytes((129, 97, 185, 97))
    assert C.lzw_encode(bytes((45, 45, 45, 45, 45, 65, 45, 45, 45, 66))) == bytes((0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01))
    assert C.ascii85_encode(b"\0" * 4) == b"z~>" and C.ascii85_decode(b" z\n~>") == b"\0" * 4
    assert C.ascii_hex_decode(b"4 a4\n5>zz") == bytes((0x4A, 0x45)) and C.ascii_hex_decode(b"7>") == b"p"
    for bad in (lambda: C.rle_decode(b"\x05ab"), lambda: C.inflate(b"\x78"), lambda: C.lzw_decode(b"\xff\xff")):
        with pytest.raises((ValueError, zlib.error)):
            bad()


def test_long_lzw_passes_all_widths():
    data = bytes((i * i + i // 7) % 251 for i in range(60_000))
    assert C.lzw_decode(C.lzw_encode(data)) == data


def test_columns_tell_errors(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(bytearray(zlib.compress(b"abc")),), (bytearray(b"junk"),), (None,)], "b binary")
    got = df.select(C.try_decode(F.col("b"), "deflate").alias("x")).select("x.*").collect()
    assert bytes(got[0]["value"]) == b"abc" and got[0]["error"] is None
    assert got[1]["value"] is None and "rror" in got[1]["error"] and got[2]["value"] is None and got[2]["error"] is None
    with pytest.raises(ValueError):
        C.encode(F.col("b"), "nothing")


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 9), st.integers(1, 4), st.integers(1, 4), st.randoms())
def test_predictors_invert(width, components, rows, random):
    data = bytes(random.randrange(256) for _ in range(width * components * rows))
    for kind in (*P.PNG, "optimum"):
        for entropy in P.ENTROPIES:
            assert P.unpredict(P.predict(data, kind, width, components, entropy), kind, width, components) == data
    for bits in (8, 16):
        wide = data * 2 if bits == 16 else data
        assert P.tiff_unpredict(P.tiff_predict(wide, width, components, bits), width, components, bits) == wide


def test_predictor_forms():
    assert P.predict(bytes((1, 2, 4, 3, 3, 3)), "sub", 3, 1) == bytes((1, 1, 1, 2, 1, 3, 0, 0))
    assert P.predict(bytes((1, 2, 3, 3)), "up", 2, 1) == bytes((2, 1, 2, 2, 2, 1))
    assert P.tiff_predict(bytes((0b00011011,)), 4, 1, 2) == bytes((0b00010101,))
    with pytest.raises(ValueError):
        P.predict(b"abc", "sub", 2, 1)
    assert P.configurations(3) == [(2, 1, 12), (2, 2, 6), (2, 3, 4), (2, 4, 3), (4, 1, 6), (4, 2, 3), (4, 3, 2), (8, 1, 3), (8, 3, 1)]


def test_gray_and_parity():
    assert P.only_gray(bytes((5, 5, 6, 9, 9, 9))) and not P.only_gray(bytes((5, 5, 7))) and not P.only_gray(b"ab")
    assert P.to_gray(b"abcdef") == b"ad"
    assert P.same_parity(bytes((2, 4, 5, 255, 3, 2))) == bytes((2, 4, 4, 255, 3, 3))
    assert P.shannon(P.np.frombuffer(b"aabb", P.np.uint8)) == 1.0 and P.entropy_sum(P.np.frombuffer(b"\x80\x81", P.np.uint8)) == 1.0
