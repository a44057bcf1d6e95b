"""WARC archives: round trips, and damage that the reader must notice."""

import base64
import hashlib
import zlib

import pytest

from shelfmark.llm import warc
from shelfmark.session import work_folder

ROWS = [
    (1, "http://a/1", "<p>same</p>"), (7, "http://a/7", "<p>same</p>"), (3, "http://a/3", "<p>same</p>"), (4, "http://b/ \r\nX: y", "<p>ü 日</p>"), (5, None, None), (6, "http://c", ""),
    (8, "http://d", "big " * 400_000), (None, "http://e", "<p>same</p>"), (9, "http://f", "WARC/1.1\r\n\r\n\x00\x1f\x8b"), (10, "u", "rep"), (10, "u", "rep"), (-2, "v", "neg"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, record_type string").repartition(3)


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def wanted(rows):
    out = []
    for page, _, html in rows:
        html = html or ""
        last = max(p for p, _, h in rows if (h or "") == html and p is not None)
        revisit = page is not None and page < last
        out.append((page, len(html.encode()), digest(html), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    found = warc.archive_round_trip(spark, pages(spark))
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()]
    assert sorted(rows, key=str) == wanted(ROWS)


def test_payloads_and_urls_come_back(spark):
    manifest = warc.write_archives(pages(spark), work_folder(spark, "test"))
    assert sum(r.records for r in manifest.collect()) == len(ROWS)
    found = {r.page_id: r for r in warc.read_archives(manifest).collect()}
    assert found[8].payload.decode() == "big " * 400_000 and found[4].payload.decode() == "<p>ü 日</p>"
    assert found[1].payload is None and found[4].url == "http://b/%20%0D%0AX:%20y" and found[5].url is None


def test_small_payloads_can_be_left_alone(spark):
    manifest = warc.write_archives(pages(spark), work_folder(spark, "test"), min_bytes=5)
    kinds = {(r.page_id, r.record_type) for r in warc.read_archives(manifest, payloads=False).collect()}
    assert {(5, "response"), (6, "response"), (1, "revisit"), (7, "response")} <= kinds


def test_archives_roll(spark, monkeypatch):
    record = warc.pack(warc.record(1, "u", b"x", None))
    assert list(warc.members(iter([record[:10], record[10:] + record, record]))) == [warc.record(1, "u", b"x", None)] * 3


def test_empty_table(spark):
    assert warc.archive_round_trip(spark, pages(spark, [])).collect() == []


@pytest.mark.parametrize(
    "damage",
    [
        lambda r: r.replace(b"payload", b"paYload"),
        lambda r: r.replace(b"\r\n\r\npay", b"\r\n\r\npaypay"),
        lambda r: r[:-4],
        lambda r: b"HTTP" + r,
    ],
)
def test_damaged_records(damage):
    good = warc.record(1, "http://a", b"payload", None)
    assert warc.parse(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(damage(good))


def test_cut_archives():
    data = warc.pack(warc.record(1, "http://a", b"payload" * 100, None))
    with pytest.raises(ValueError):
        list(warc.members(iter([data[:-9]])))
    with pytest.raises(zlib.error):
        list(warc.members(iter([b"plain text"])))


def test_an_archive_cut_between_records_is_an_error(spark, tmp_path):
    """Whole members before the cut read well; the manifest tells that some are missing, or all."""
    import gzip

    from shelfmark.llm import warc as W

    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}") for i in range(20)], "page_id bigint, url string, html string").coalesce(1)
    manifest = W.write_archives(pages, f"file://{tmp_path}")
    assert W.read_archives(manifest).count() == 20
    path = manifest.where("records > 1").first()["path"].removeprefix("file://")
    whole = open(path, "rb").read()
    cuts = [i for i in range(1, len(whole)) if whole[i : i + 3] == b"\x1f\x8b\x08"]
    first = next(i for i in cuts if gzip.decompress(whole[:i]))
    for left in (whole[:first], b""):
        open(path, "wb").write(left)
        with pytest.raises(Exception, match="manifest says"):
            W.read_archives(manifest).count()


@pytest.mark.parametrize(
    ("path", "same"),
    [("s3a://b/x", "s3://b/x"), ("S3N://b/x", "s3://b/x"), ("/a/b:c", "/a/b:c"), ("file:///a", "file:///a"), ("file:/a", "file:/a"), ("abfss://c@d/e", "abfss://c@d/e")],
)
def test_paths_as_tasks_open_them(path, same):
    from shelfmark.llm._files import reachable

    assert reachable(path) == same


@pytest.mark.parametrize("path", ["dbfs:/x", "wasbs://c@d/e", "oss://b/x"])
def test_a_folder_that_tasks_cannot_open_fails_before_the_job(spark, path):
    from public_tokenizers import path as tokenizer

    from shelfmark.llm import token_files

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        warc.write_archives(pages(spark), path)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        token_files.write_token_files(spark.createDataFrame([(1, "x")], "doc_id long, text string"), path, tokenizer("byte_bpe_50k.json"))
