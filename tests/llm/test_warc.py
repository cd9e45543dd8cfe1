"""WARC archives: exact round trip, dictionary frame, revisits."""

import base64
import glob
import hashlib

import zstandard

from siltstone.llm import warc

PAGES = [
    (1, "http://a.example/1", "<p>same</p>"),
    (2, "http://a.example/2", "<p>same</p>"),
    (3, None, "<p>other é 🙂</p>\r\n\r\n<p>WARC/1.1</p>"),
    (4, "http://b.example/a b\n", None),
    (5, "http://b.example/", ""),
    (9, "http://c.example/", "<p>same</p>"),
    (9, "http://c.example/", "<p>same</p>"),
    (None, "http://d.example/", "<p>same</p>"),
    (7, "http://e.example/", "x" * 300_000),
]


def want(rows):
    def sha(h):
        return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()

    out = []
    for i, _, h in rows:
        ids = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        top = max(ids, default=None)
        again = i is not None and i != top
        out.append((str(i), len((h or "").encode()), sha(h), "revisit" if again else "response", str(top if again else None)))
    return sorted(out)


def got(records):
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in records)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "0 AS keeper", "'x' AS _sha").repartition(3)
    manifest, records = warc.archive(pages, f"file://{tmp_path}/out")
    rows = records.collect()
    assert got(rows) == want(PAGES)
    assert {r.page_id: r.payload.decode() for r in rows if r.record_type == "response" and r.page_id in (3, 5, 7, 9)} == {
        i: h or "" for i, _, h in PAGES if i in (3, 5, 7, 9)
    }
    assert {r.url for r in rows if r.page_id == 4} == {"http://b.example/a%20b%0A"}
    assert {r.payload for r in rows if r.record_type == "revisit"} == {None}
    assert sum(r.records for r in manifest.collect()) == len(PAGES)


def test_small_payloads_are_never_revisited(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = warc.archive(pages, min_bytes=1)[1].collect()
    assert {r.record_type for r in rows if r.page_id in (4, 5)} == {"response"}


def test_files_start_with_the_dictionary_and_hold_a_frame_a_record(spark, tmp_path):
    many = [(i, f"http://h.example/{i}", f"<html><body><p>page {i} " + "words of a page " * (i % 7) + "</p></body></html>") for i in range(400)]
    pages = spark.createDataFrame(many, "page_id long, url string, html string").coalesce(1)
    warc.archive(pages, f"file://{tmp_path}/out")
    (path,) = glob.glob(f"{tmp_path}/out/*.warc.zst")
    with open(path, "rb") as f:
        raw = warc.read_dictionary(f)
        assert zstandard.ZstdCompressionDict(raw).dict_id() != 0
        frames = list(warc.read_archive(open(path, "rb")))
    assert len(frames) == 400
    assert all(x.startswith(b"WARC/1.1\r\n") for x in frames)


def test_a_full_archive_is_followed_by_another(spark, tmp_path):
    many = [(i, None, f"page {i} " * 40) for i in range(30)]
    pages = spark.createDataFrame(many, "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/out", archive_bytes=1)
    listed = spark.createDataFrame(manifest.collect(), warc.MANIFEST)
    assert listed.count() == 30
    assert sorted(r.page_id for r in warc.read_archives(listed).collect()) == list(range(30))


def test_equal_tables_give_equal_dictionaries(spark, tmp_path):
    many = [(i, None, f"<p>page {i * 7919 % 1000} words of it</p>") for i in range(500)]
    found = set()
    for k in (1, 5):
        warc.archive(spark.createDataFrame(many, "page_id long, url string, html string").repartition(k), f"file://{tmp_path}/{k}")
        with open(sorted(glob.glob(f"{tmp_path}/{k}/*.warc.zst"))[0], "rb") as f:
            found.add(warc.read_dictionary(f))
    assert len(found) == 1


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    manifest, records = warc.archive(pages)
    assert manifest.count() == records.count() == 0
