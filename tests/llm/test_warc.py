import base64
import hashlib

from tokenloom.llm import warc

PAGES = [
    (1, "http://a.example/x", '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><h1>Head</h1><!-- no --><p>One <b>two</b>&nbsp;three<br>four <a href="/l?x=1&amp;y=2">link</a> 1 < 2</p></body></html>'),
    (2, None, None), (3, "http://b.example/\r\nx", ""), (4, "u", "<p>open <script>never closed"), (4, "u", "<p>open <script>never closed"), (None, "n", "plain \r\n\r\n WARC/1.1 text\n\n<p>é"), (6, "c", "<!-- open"),
]


def build(spark, pages=PAGES):
    return warc.build_derivatives(spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, record string")).collect()


def test_records_are_linked_and_whole(spark):
    got = build(spark)
    assert len(got) == 2 * len(PAGES)
    source = {(str(r.page_id), r.record_id) for r in warc.responses(spark.createDataFrame(PAGES, "page_id long, url string, html string")).collect()}
    for r in got:
        assert (str(r.page_id), r.refers_to) in source
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(r.block.encode()).digest()).decode()
        assert int(r.headers["Content-Length"]) == len(r.block.encode())
        assert r.date == warc.DATE
    assert sorted(r.record_type for r in got) == ["conversion"] * len(PAGES) + ["metadata"] * len(PAGES)


def test_conversion_and_metadata(spark):
    got = {(r.page_id, r.record_type): r for r in build(spark)}
    assert got[1, "conversion"].block == "Head\nOne two three\nfour link 1 < 2"
    lines = got[1, "metadata"].block.split("\r\n")
    assert "title: A & B" in lines and "language: en" in lines and "charset: utf-8" in lines and "outlink: /l?x=1&y=2" in lines
    assert "http-status: HTTP/1.1 200 OK" in lines and "http-content-type: text/html; charset=utf-8" in lines
    payload = "sha1:" + base64.b32encode(hashlib.sha1(PAGES[0][2].encode()).digest()).decode()
    assert f"response-payload-digest: {payload}" in lines
    assert got[2, "conversion"].block == "" and got[2, "conversion"].target_uri is None
    assert got[4, "conversion"].block == "open" and got[6, "conversion"].block == ""
    assert got[None, "conversion"].block == "plain\nWARC/1.1 text\né"


def test_hostile_pages_are_read_in_linear_time():
    for page in ("<" * 300_000, "<script" * 60_000, "<!--" * 80_000, "<a href=" * 50_000, "&" * 300_000):
        warc.convert(page)


def test_files_are_bounded(spark, tmp_path):
    records = warc.derivatives(warc.responses(spark.createDataFrame(PAGES * 3, "page_id long, url string, html string").coalesce(1)))
    warc.write_warc(records, str(tmp_path / "w"), per_file=10)
    assert len(list((tmp_path / "w").glob("part-*"))) == 5
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 6 * len(PAGES)


def test_empty_table(spark):
    assert build(spark, []) == []
