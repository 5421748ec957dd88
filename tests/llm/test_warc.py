import base64
import hashlib
import uuid

from ligature.llm import warc
from ligature.llm.common import shared_folder


def test_round_trip_with_magic_inside_payloads(spark):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "http://a/ü?x=1&y", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "c", ""), (5, "d", f"x{inner}y"), (6, "e", inner + inner), (7, "f", "WARC/1.0\r\n"), (None, "g", "<p>é</p>"), (8, "h", "tail" * 50), (2, "i", "other"), (9, "k", "WARC/1.0\r\nContent-Length: 999999\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    path = f"{shared_folder(spark)}/w-{uuid.uuid4().hex}"
    warc.write_archives(df, path)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(pages)
    first = {}
    for i, _, h in sorted(pages, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    want = set()
    for i, u, h in pages:
        data = (h or "").encode()
        whole = first[h or ""] == i
        want.add((i, u or "", "response" if whole else "revisit", None if whole else first[h or ""], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), data if whole else None))
    assert {(r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload) if r.payload is not None else None) for r in got} == want
    light = warc.read_archives(spark, path, payloads=False).drop("payload").collect()
    assert {tuple(r) for r in light} == {w[:1] + (w[1],) + w[2:6] for w in want}


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long enough"), (4, "d", "long enough")], "page_id long, url string, html string")
    kinds = {r.page_id: r.refers_to for r in warc.with_types(df, least=5).collect()}
    assert kinds == {1: None, 2: None, 3: None, 4: 3}


def test_empty_table(spark):
    path = f"{shared_folder(spark)}/w-{uuid.uuid4().hex}"
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_reading_does_not_depend_on_how_scans_are_split(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(i, f"http://a/{i}", f"x{inner}{'y' * (i * 37 % 300)}{inner if i % 3 else ''}") for i in range(60)]
    path = f"{shared_folder(spark)}/w-{uuid.uuid4().hex}"
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    turn, old = [0], DataFrameWriter.parquet

    def parquet(self, *args, **kwargs):
        old(self, *args, **kwargs)
        turn[0] += 1
        spark.conf.set("spark.sql.files.minPartitionNum", str((2, 11, 1, 7)[turn[0] % 4]))

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "5")
    try:
        for payloads in (True, False):
            got = warc.read_archives(spark, path, payloads=payloads).collect()
            assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == [(i, len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for i, _, h in pages]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_records_have_their_mandatory_fields(spark):
    path = f"{shared_folder(spark)}/w-{uuid.uuid4().hex}"
    warc.write_archives(spark.createDataFrame([(1, "http://a/b?c=%20d", "x"), (2, "http://a/é", "x")], "page_id long, url string, html string"), path, date="2001-02-03T04:05:06Z", compression="gzip")
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    assert text.count("WARC-Date: 2001-02-03T04:05:06Z\r\n") == 2 and text.count(f"WARC-Profile: {warc.PROFILE}\r\n") == 1
    assert "WARC-Target-URI: http://a/b?c=%20d\r\n" in text
    assert {(r.page_id, r.url) for r in warc.read_archives(spark, path).collect()} == {(1, "http://a/b?c=%20d"), (2, "http://a/é")}
