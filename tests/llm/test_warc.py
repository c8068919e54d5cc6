import base64
import glob
import gzip
import hashlib

from tallyspark.llm import warc

PAGES = "page_id long, url string, html string, row long, file string"


def pages(spark):
    rows = [(1, "http://a/ b", "same"), (2, "http://b/", "same"), (3, None, "same"), (4, "http://c/", None), (5, "http://d/", ""), (6, "http://e/\r\nX-Y: z", "a\r\n\r\nWARC/1.1\r\nb"), (7, "http://f/", "é" * 100_000), (8, "http://g/", "only"), (9, "http://h/", "same "), (8, "http://g/", "only")]
    return spark.createDataFrame([(*r, None, "x") for r in rows], PAGES).repartition(3)


def test_round_trip(spark, tmp_path):
    folder = str(tmp_path / "out")
    files = warc.archive_and_deduplicate(pages(spark), folder=folder)
    got = {}
    for r in warc.read_archives(spark, files).collect():
        got.setdefault(r["page_id"], []).append(r)
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    for page, payload, to in ((1, b"same", 3), (2, b"same", 3), (3, b"same", None), (4, b"", 5), (5, b"", None), (7, ("é" * 100_000).encode(), None), (9, b"same ", None), (6, b"a\r\n\r\nWARC/1.1\r\nb", None)):
        (r,) = got[page]
        assert (r["payload_digest"], r["payload_bytes"], r["refers_to"]) == (digest(payload), len(payload), to)
        assert r["record_type"] == ("revisit" if to else "response") and (r["payload"] is None if to else bytes(r["payload"]) == payload)
    assert sorted(r["record_type"] for r in got[8]) == ["response", "revisit"] and {r["refers_to"] for r in got[8]} == {None, 8}
    by_record = {r["record_id"]: r for rs in got.values() for r in rs}
    assert all(by_record[r["refers_to_record"]]["record_type"] == "response" for r in by_record.values() if r["refers_to_record"])
    text = b"".join(gzip.open(f).read() for f in glob.glob(f"{folder}/*.warc.gz"))  # members of a plain gzip file
    assert text.count(b"WARC-Type: revisit\r\n") == 4 and text.count(b"\r\nWARC-Record-ID: ") == 10


def test_small_payloads_are_kept(spark):
    files = warc.archive_and_deduplicate(pages(spark), min_bytes=5)
    kinds = {r["page_id"]: r["record_type"] for r in warc.read_archives(spark, files, with_payload=False).collect()}
    assert set(kinds.values()) == {"response"}


def test_empty(spark):
    files = warc.archive_and_deduplicate(pages(spark).limit(0))
    assert warc.read_archives(spark, files).count() == 0
