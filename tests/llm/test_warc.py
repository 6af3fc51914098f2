import gzip
import hashlib
import io

import pytest

from docgrain.llm import warc as W

PAGE = "page_id long, url string, html string"


def brute(rows):
    best = {}
    for k, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000 and k is not None:
            best[raw] = max(best.get(raw, k), k)
    out = []
    for k, _, h in rows:
        raw = (h or "").encode()
        kept = best.get(raw, k)
        again = len(raw) >= 1000 and raw in best and kept != k
        out.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", kept if again else None))
    return sorted(out, key=str)


def test_round_trip_with_revisits(spark):
    long, other = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 60, "x" * 1000
    rows = [(1, "http://a/", long), (7, "http://a/ b\r\nX: y", long), (3, None, long), (4, "u", other), (9, "u", other), (9, "u", other), (5, "u", "x" * 999), (6, "u", "x" * 999), (8, None, None), (None, "n", long), (10, "u", "")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, PAGE).withColumn("digest", F.lit("clash")).withColumn("kept", F.lit(1))
    got = [tuple(r) for r in W.archived(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == brute(rows)
    assert W.archived(spark.createDataFrame([], PAGE)).count() == 0


def test_predicates_reach_the_reader(spark, tmp_path):
    W.register(spark)
    df = spark.createDataFrame([(i, f"http://h{i % 2}/p{i}", "y" * (10 * i)) for i in range(20)], PAGE).coalesce(3)
    path = "file://" + str(tmp_path / "w")
    W.write_warc(df, path)
    back = spark.read.format("warc").load(path)
    part = back.where("target_uri like 'http://h1/%' and record_type = 'response' and content_length > 100")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    assert part.count() == sum(1 for i in range(20) if i % 2 and len(str(10 * i)) + 10 * i + 70 > 100)
    assert spark.read.format("warc").option("payload", "false").load(path).where("payload is null").count() == 20
    one = spark.read.format("warc").option("partitionBytes", "1").load(path)
    assert one.rdd.getNumPartitions() == 3 and one.count() == 20


def record(kind, body, more=""):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{more}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_foreign_archives_plain_and_gzip():
    data = record("warcinfo", b"software: x") + record("response", b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\nX: a\r\n b\r\n\r\nabc", "Content-Type: application/http; msgtype=response\r\n") + record("resource", b"", "Content-Type: text/plain\r\n")
    for file, plain in ((io.BytesIO(data), True), (gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(data[:80]) + gzip.compress(data[80:]))), False)):
        got = list(W.records(file, plain))
        assert [(r["record_type"], r["payload"], r["http_length"]) for r in got] == [("warcinfo", b"software: x", None), ("response", b"abc", 3), ("resource", b"", None)]
    with pytest.raises(ValueError):
        list(W.records(io.BytesIO(data[:-20]), True))
    with pytest.raises(ValueError):
        list(W.records(io.BytesIO(b"GARBAGE\r\n" + data), True))


def test_http_heads_stay_inside_their_records():
    kind = "Content-Type: application/http;msgtype={}\r\n".format
    data = (
        record("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", kind("request"))
        + record("response", b"", kind("response"))
        + record("response", b"HTTP/1.1 200 OK", kind("response"))
        + record("response", b"HTTP/1.1 200 OK\r\nContent-Length: 0\r\n\r\n", kind("response"))
        + record("response", b"no status line, no line end", kind("response"))
        + record("response", b"HTTP/1.1 204\r\nX: y", kind("response"))
        + record("resource", b"after")
    )
    want = [b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", b"", b"", b"", b"no status line, no line end", b"", b"after"]
    for zipped in (False, True):
        file = gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(data))) if zipped else io.BytesIO(data)
        got = list(W.records(file, not zipped))
        assert [r["payload"] for r in got] == want and [r["http_length"] for r in got] == [None, None, None, 0, None, None, None]
        file.seek(0)
        assert len(list(W.records(file, not zipped, payload=False))) == 7


@pytest.mark.parametrize("zipped", [False, True])
def test_cut_archives_raise_with_and_without_payloads(zipped):
    data = record("resource", b"x" * 500) + record("resource", b"y" * 500)
    for cut in (100, 700):
        part = data[:cut]
        for payload in (True, False):
            file = gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(part))) if zipped else io.BytesIO(part)
            with pytest.raises(ValueError):
                list(W.records(file, not zipped, payload=payload))
