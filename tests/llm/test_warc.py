"""WARC derivatives."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from archipelago.llm import oracles, warc
from tests.llm.conftest import same

SCHEMA = "page_id bigint, url string, html string"
PAGE = """<!DOCTYPE html><html><head><title>No</title></head><body><!-- <p>no</p> --><script>var t="</p>"</script>
<style>p {}</style><h1>A &amp; B</h1><p>one<b>two</b>
 three</p><P>four&nbsp;&lt;x&gt;<br/>five</p></body></html>"""


def parsed(record: str) -> tuple[dict, str]:
    head, block = record.split("\r\n\r\n", 1)
    first, *lines = head.split("\r\n")
    assert first == "WARC/1.1"
    return dict(line.split(": ", 1) for line in lines), block.removesuffix("\r\n\r\n")


def test_records(spark):
    pages = spark.createDataFrame([(1, "http://a.example/é", PAGE), (1, "http://a.example/é", PAGE), (2, None, None)], SCHEMA)
    clash = {n: F.lit(n) for n in ("kind", "record", "_text", "payload", "block")}
    sources = warc.responses(pages.withColumns(clash))
    known = {r["record_id"]: r for r in sources.collect()}
    rows = warc.derivatives(sources, "page_id").collect()
    assert len(rows) == 6 and len(known) == 2
    by_id = {r["record_id"]: r for r in rows}
    for row in rows:
        source = known[row["refers_to"]]
        fields, block = parsed(row["record"])
        assert block == row["block"]
        assert fields["WARC-Type"] == row["kind"] and fields["WARC-Record-ID"] == row["record_id"]
        assert fields["WARC-Refers-To"] == source["record_id"]
        assert fields["WARC-Target-URI"] == source["target_uri"] and fields["WARC-Date"] == source["date"]
        assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(source["payload"].encode()).hexdigest()
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block.encode()).hexdigest()
        assert int(fields["Content-Length"]) == len(block.encode())
        if row["kind"] == "metadata":
            about = dict(line.split(": ", 1) for line in block.removesuffix("\r\n").split("\r\n"))
            text = by_id[about["conversion"]]
            assert text["kind"] == "conversion" and text["refers_to"] == row["refers_to"]
            assert about["source-content-type"] == "text/html; charset=utf-8"
            assert int(about["source-content-length"]) == len(source["payload"].encode())
            assert int(about["text-characters"]) == len(text["block"])
    assert by_id[next(i for i, r in by_id.items() if r["page_id"] == 1 and r["kind"] == "conversion")]["block"] == (
        "A & B\nonetwo three\nfour <x>\nfive"
    )


def test_given_headers_are_kept(spark):
    headers = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX: y\r\n"
    rows = [("<urn:uuid:1>", "u", "2020-01-01T00:00:00Z", headers, "<p>x</p>"), (None, None, None, None, None)]
    sources = spark.createDataFrame(rows, "record_id string, target_uri string, date string, http_headers string, payload string")
    found = warc.derivatives(sources).collect()
    assert {r["refers_to"] for r in found} == {"<urn:uuid:1>", ""}
    assert any("source-content-type: text/html\r\n" in r["block"] for r in found)


def test_all_header_fields_are_kept(spark):
    headers = "HTTP/1.1 200 OK\r\nServer: a: b\r\ncontent-type: text/html;\r\n charset=utf-8\r\nSet-Cookie: x=1\r\nContent-Length: 8\r\nSet-Cookie: y=2\r\nContent-Type: text/plain\r\n\r\n"
    rows = [("<urn:uuid:1>", "u", "2020-01-01T00:00:00Z", headers, "<p>x</p>")]
    sources = spark.createDataFrame(rows, "record_id string, target_uri string, date string, http_headers string, payload string")
    [about] = warc.derivatives(sources).filter("kind = 'metadata'").collect()
    lines = about["block"].removesuffix("\r\n").split("\r\n")
    assert "source-content-type: text/html; charset=utf-8" in lines and "source-content-length: 8" in lines
    assert [line.removeprefix("source-header: ") for line in lines if line.startswith("source-header: ")] == [
        "Server: a: b", "Set-Cookie: x=1", "Set-Cookie: y=2", "Content-Type: text/plain"
    ]
    assert f"\r\nContent-Length: {len(about['block'].encode())}\r\n" in about["record"]


def test_all_references_are_decoded_once(spark):
    page = "<p>&copy; 2024 &middot; caf&eacute;&nbsp;&#8217;&#x27;&#X41; &amp;lt; &amp;copy; &lt;b&gt; &hearts; &none; 日本</p>"
    pages = spark.createDataFrame([(1, "u", page), (2, "u", None)], SCHEMA)
    found = warc.derivatives(warc.responses(pages), "page_id", all_references=True).filter("kind = 'conversion'")
    same(
        found.select("page_id", "block").collect(),
        [(1, "© 2024 · café ’'A &lt; &copy; <b> ♥ &none; 日本"), (2, "")],
    )


def test_empty_table_and_long_pages(spark):
    nothing = warc.responses(spark.createDataFrame([], SCHEMA))
    assert warc.derivatives(nothing).collect() == []
    long = warc.responses(spark.createDataFrame([(1, "u", "<p>word</p>" * 100_000)], SCHEMA))
    same(
        warc.derivatives(long).filter("kind = 'conversion'").select(F.length("block")).collect(),
        [(5 * 100_000 - 1,)],
    )


def test_sql_decodes_as_the_query(spark):
    """The table of references in the SQL, against HTML's own decoding, on mixed-up references."""
    import random
    from html import unescape
    from html.entities import html5

    duckdb = pytest.importorskip("duckdb")
    draw, names = random.Random(1), list(html5)
    texts = ["", "&", "&&lt", "&amp;lt;", "&notit;", "&copyx &copy;", "&#0;&#13;&#128;&#x9f;&#1;&#xD800;&#x110000;", "&#65", "&#;&x;& a;"]
    for _ in range(500):
        kinds = ["&", "&#", ";", " ", "é", "&" + draw.choice(names), "&" + draw.choice(names)[:4], f"&#{draw.randrange(0x120000)};"]
        texts.append("".join(draw.choices(kinds, k=draw.randint(1, 6))))
    connection = duckdb.connect()
    connection.execute("create table given(i int, bare varchar)")
    connection.executemany("insert into given values (?, ?)", list(enumerate(texts)))
    sql = f"with stripped as (select * from given), {oracles._decoded('bare')} select bare_text from decoded order by i"
    assert [row[0] for row in connection.execute(sql).fetchall()] == [unescape(t) for t in texts]


def test_status_line(spark):
    headers = ["HTTP/1.1 404 Not Found\r\nServer: x\r\n", "Server: x\r\n", "", None, "HTTP/2 200\r\n", "HTTP/1.0 200 OK"]
    rows = [(f"<urn:uuid:{i}>", "u", "d", h, "") for i, h in enumerate(headers)]
    sources = spark.createDataFrame(rows, "record_id string, target_uri string, date string, http_headers string, payload string")
    found = {r["refers_to"]: r["block"] for r in warc.derivatives(sources).filter("kind = 'metadata'").collect()}
    said = [found[f"<urn:uuid:{i}>"].split("\r\n")[1] for i in range(len(headers))]
    assert said == [f"source-status: {x}" for x in ("HTTP/1.1 404 Not Found", "", "", "", "HTTP/2 200", "HTTP/1.0 200 OK")]


def by_expressions(html):
    """The steps before references are decoded, as Spark's own expressions."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for name in warc.HIDDEN:
        text = F.regexp_replace(text, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "")
    text = F.regexp_replace(text, r"[\r\n\t ]+", " ")
    text = F.regexp_replace(text, rf"(?i)</?({warc.BREAKS})\b[^>]*>", "\n")
    return F.regexp_replace(text, r"(?s)<[^>]*>", "")


def test_odd_pages_are_read_as_by_expressions(spark):
    import random
    from html import unescape

    draw = random.Random(3)
    names = [*warc.HIDDEN, *warc.BREAKS.split("|"), "b", "headline", "scripté", "ṕ", "p1", "p-x", "p_", "ſcript", "blocKquote"]
    after = ["", " ", "\t", "\n", "\x0b", "\f", "\xa0", "/", " a='x'", " a='>'", "é", "́", "١", "⃣", "日", "😀", "'"]
    plain = ["a", " ", "  ", "\n", "\r\n", "\t", "é", "日本", "\x0b", "\x00", "&amp;", "&amp;lt;", "&nbsp;", "&#160;", "&copy;", "\xa0", "&lt;p&gt;",
             "<", ">", "</", "<!--", "-->", "--", "\\1", "$1"]

    def piece():
        if draw.random() < 0.4:
            return draw.choice(plain)
        name = draw.choice(names[:5] if draw.random() < 0.5 else names)
        name = "".join(draw.choice((c, c.upper() if c.isascii() else c)) for c in name)
        return f"<{draw.choice(('', '/'))}{name}{draw.choice(after) if draw.random() < 0.5 else ''}{draw.choice('>>>>>> ')}"

    pages = [(i, "u", "".join(piece() for _ in range(draw.randint(0, 40)))) for i in range(3000)] + [(3000, "u", None)]
    given = spark.createDataFrame(pages, SCHEMA)
    found = given.select("page_id", by_expressions(F.col("html")), warc.plain_text("html", True), warc.plain_text("html")).collect()

    def lines(text):
        import re

        return re.sub(r" *\n[ \n]*", "\n", text).strip(" \n")

    def six(text):
        for entity, character in warc.ENTITIES:
            text = text.replace(entity, character)
        return text

    same(
        [(i, every, few) for i, _, every, few in found],
        [(i, None, None) if t is None else (i, lines(unescape(t).replace("\xa0", " ")), lines(six(t))) for i, t, _, _ in found],
    )


def test_long_pages_that_leave_elements_open(spark):
    """Time is linear in a page's length; where each open tag is searched to the end of the page this takes minutes."""
    import time

    pages = [(i, "u", tag * 300_000) for i, tag in enumerate(("<script>", "<!--", "<head a='x'>", "&nbsp;"))]
    given = spark.createDataFrame(pages, SCHEMA)
    start = time.monotonic()
    found = given.select("page_id", warc.plain_text("html", True)).collect()
    assert time.monotonic() - start < 30
    same(found, [(0, ""), (1, "<!--" * 300_000), (2, ""), (3, "")])
