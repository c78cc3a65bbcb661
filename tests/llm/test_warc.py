import gzip
import hashlib
import html as H
import pathlib
import re
import time

import pytest

from quillon.llm.warc import CRLF, derive, plain_text, responses_from_pages, write_warc

PAGES = [
    (1, "http://a/", '<html><head><style>p{}</style><script>var t="</p>";</script></head><body><p>One&nbsp;&amp;amp; two<br>three<!-- x > y --></p><a href="/x">L</a> <b>bo</b>ld &#233;&#9731;&#1114112;&#x; &lt;i&gt;</body>'),
    (2, None, None),
    (2, "http://b/", ""),
    (3, "http://c/?a=1&b=2", "<p>" + "word " * 60_000 + "<a HREF = 'q'>x</a><script>never closed"),
    (None, "http://d/", "a < b\r\n\r\n\r\nc <1> &unknown;"),
]


@pytest.fixture(scope="module")
def rows(spark):
    pages = spark.createDataFrame([(*p, "clash", 7) for p in PAGES + PAGES[:1]], "page_id long, url string, html string, block string, record_id int")
    return derive(responses_from_pages(pages), keep=("page_id",)).collect()


def test_links_and_digests(rows):
    assert len(rows) == 12
    for r in rows:
        block = r.block.encode()
        assert r.content_length == len(block) and r.block_digest == "sha256:" + hashlib.sha256(block).hexdigest()
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}>", r.record_id)
        if r.warc_type == "metadata":
            assert f"source-payload-digest: {r.source_payload_digest}{CRLF}" in r.block
            assert "source-header: HTTP/1.1 200 OK" + CRLF + "source-header: Content-Type: text/html" in r.block
    by = {}
    for r in rows:
        by.setdefault(r.refers_to, set()).add((r.warc_type, r.record_id))
    assert len(by) == 5 and all(len(v) == 2 for v in by.values())
    one = next(r for r in rows if r.page_id == 1 and r.warc_type == "metadata")
    assert "outlinks: 1" + CRLF in one.block and one.source_payload_digest == "sha256:" + hashlib.sha256(PAGES[0][2].encode()).hexdigest()


def test_text(rows):
    text = {(r.page_id, r.target_uri): r.block for r in rows if r.warc_type == "conversion"}
    assert text[1, "http://a/"] == "One &amp; two\nthree\nL bold é☃&#1114112;&#x; <i>"
    assert text[2, ""] == text[2, "http://b/"] == ""
    assert text[3, "http://c/?a=1&b=2"] == " ".join(["word"] * 60_000) + " x"
    assert text[None, "http://d/"] == "a < b\nc <1> &unknown;"


def test_references_equal_the_standard_library(spark):
    values = [f"a&#{n};b" for n in (1, 38, 65, 160, 255, 8364, 128512, 1114111)] + ["&#x41;&#X1F600;", "&amp;lt; &copy;&middot;&Eacute;&euro;&apos;&sum; &nosuch; & z"]
    out = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(plain_text("v")).collect()]
    assert [o for o, v in zip(out, values) if "&#1;" not in v and "&#160;" not in v and "&#111" not in v] == [H.unescape(v) for v in values if "&#1;" not in v and "&#160;" not in v and "&#111" not in v]


def test_files_can_be_read_back(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    out = derive(responses_from_pages(pages)).coalesce(2)
    write_warc(out, f"file://{tmp_path}/w")
    got = []
    for f in pathlib.Path(tmp_path, "w").glob("*.gz"):
        data = gzip.open(f).read()
        while data:
            head, data = data.split(b"\r\n\r\n", 1)
            fields = dict(x.split(": ", 1) for x in head.decode().split(CRLF)[1:])
            n = int(fields["Content-Length"])
            block, end, data = data[:n], data[n : n + 4], data[n + 4 :]
            assert end == b"\r\n\r\n" and fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
            got.append(fields["WARC-Record-ID"])
    assert sorted(got) == sorted(r.record_id for r in out.collect())


def test_empty_and_headless(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert derive(responses_from_pages(none)).count() == 0
    odd = spark.createDataFrame([("id", "u", "d", "HTTP/1.1 204 No Content"), (None, None, None, None)], "record_id string, target_uri string, warc_date string, block string")
    assert sorted((r.warc_type, r.source_headers, r.block) for r in derive(odd).collect() if r.warc_type == "conversion") == [("conversion", "", ""), ("conversion", "HTTP/1.1 204 No Content", "")]


def test_unclosed_tags_take_linear_time(spark):
    """A megabyte of each: with a pattern that goes over the rest of the text at every <, one would take hours."""
    n = 1_000_000
    pages = [(1, "u", "<a" * (n // 2)), (2, "u", "<script" * (n // 7)), (3, "u", "<p <!- " * (n // 7)), (4, "u", "<a href " * (n // 8)), (5, "u", "<a href=x<b>y</b>"), (6, "u", "<!--" * (n // 4)), (7, "u", "&#" * (n // 2))]
    start = time.time()
    out = derive(responses_from_pages(spark.createDataFrame(pages, "page_id long, url string, html string")), keep=("page_id",)).where("warc_type = 'conversion'").collect()
    text = {r.page_id: r.block for r in out}
    assert time.time() - start < 120
    assert text[1] == pages[0][2] and text[2] == pages[1][2] and text[5] == "<a href=xy" and text[6] == "" and text[7] == pages[6][2]
