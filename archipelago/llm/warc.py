"""WARC derivatives: metadata and plain-text conversion records of response records.

Responses have ``record_id, target_uri, date, http_headers, payload``. Every response yields one
``conversion`` record, whose block is the page's visible text, and one ``metadata`` record, whose block is
a list of fields about the response. Both refer to the response by its id and keep its
target, date and digests; the conversion record can be reached from the metadata record.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the record format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
# The date of pages that come without one.
NO_DATE = "1970-01-01T00:00:00Z"
# Elements whose content isn't text, and elements that end a line.
HIDDEN = ("script", "style", "noscript", "template", "head")
BREAKS = "p|div|br|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|table|section|article|nav|header|footer|blockquote|pre|hr"
# What follows an element's name, which no letter, digit or mark goes on, up to the end of the tag.
REST_OF_TAG = r"(?:[^>_\pL\p{Nd}\p{Mn}][^>]*)?>"
BLANKS = r"[ \t\n\x0B\f\r]"
# Bytes of pages whose text is made together.
SLICE = 2 << 20
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def any_case(pattern: str) -> str:
    """A pattern whose ASCII letters stand for both cases, and for no other characters."""
    return re.sub("[a-z]", lambda letter: f"[{letter[0]}{letter[0].upper()}]", pattern)


def digest(value: Column) -> Column:
    """A labelled digest of a block or payload."""
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def record_id(*parts: Column) -> Column:
    """A record id that depends on the parts only."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    pieces = [F.substring(h, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def responses(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """Response records of pages (``page_id, url, html``).

    Null ids, addresses and pages count as empty. The record id follows from the three values, so
    equal rows are the same record.
    """
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    headers = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(html).cast("string"),
        F.lit(CRLF),
    )
    return pages.select(
        "page_id",
        record_id(F.lit("response"), number, url, F.sha2(html, 256)).alias("record_id"),
        url.alias("target_uri"),
        F.lit(date).alias("date"),
        headers.alias("http_headers"),
        html.alias("payload"),
    )


def plain_text(html: Column, all_references: bool = False) -> Column:
    """The visible text of a page: a line for each block of text, white space within lines as one blank.

    Character references other than ``ENTITIES`` stay as they are, unless ``all_references`` are decoded,
    named, decimal and hexadecimal, each once. The steps are Arrow's, whose time is linear in a page's length.
    """

    def text_of(pages: pa.Array) -> pa.Array:
        text = pc.replace_substring_regex(pages, r"(?s)<!--.*?-->", "")
        for name in map(any_case, HIDDEN):
            text = pc.replace_substring_regex(text, rf"(?s)<{name}{REST_OF_TAG}.*?</{name}{BLANKS}*>", "")
        # Blanks that stand alone stay as they are.
        text = pc.replace_substring_regex(text, r"[\r\n\t ]{2,}|[\r\n\t]", " ")
        text = pc.replace_substring_regex(text, rf"</?(?:{any_case(BREAKS)}){REST_OF_TAG}", "\n")
        text = pc.replace_substring_regex(text, r"<[^>]*>", "")
        if all_references:
            decoded = [t if t is None else unescape(t) for t in text.to_pylist()]
            text = pc.replace_substring(pa.array(decoded, pa.string()), "\u00a0", " ")
        for entity, character in () if all_references else ENTITIES:
            text = pc.replace_substring(text, entity, character)
        text = pc.replace_substring_regex(text, r" *\n[ \n]*", "\n")
        return pc.utf8_trim(text, " \n")

    @F.arrow_udf("string")
    def visible(pages: pa.Array) -> pa.Array:
        rows = max(1, len(pages) * SLICE // max(1, pages.nbytes))
        return pa.concat_arrays([text_of(pages[at : at + rows]) for at in range(0, max(1, len(pages)), rows)])

    return visible(F.make_valid_utf8(html))


def header(response_headers: Column, name: str) -> Column:
    """The value of a header field of the source; empty if it isn't there."""
    return F.trim(F.regexp_extract(response_headers, rf"(?im)^{name}:([^\r\n]*)", 1))


def status_line(response_headers: Column) -> Column:
    """The first line of the source's header, without which the header is a list of fields alone; then it is empty."""
    first = F.regexp_extract(response_headers, r"\A([^\r\n]*)", 1)
    return F.when(first.rlike(r"^[A-Za-z]+/[0-9.]+ "), first).otherwise("")


def other_headers(response_headers: Column) -> Column:
    """A line ``source-header`` for each header field but the first content type and length, in their order."""
    lines = F.filter(F.split(response_headers, "\r?\n"), lambda line: line.rlike(r"^[^:\s]+:"))
    names = F.transform(lines, lambda line: F.lower(F.substring_index(line, ":", 1)))

    def other(line: Column, at: Column) -> Column:
        name = F.get(names, at)
        return ~name.isin("content-type", "content-length") | (F.array_position(names, name) <= at)

    kept = F.transform(F.filter(lines, other), lambda line: F.concat(F.lit("source-header: "), line, F.lit(CRLF)))
    return F.array_join(kept, "")


def derivatives(sources: DataFrame, *keep: str, all_references: bool = False) -> DataFrame:
    """Two records for each response: the columns ``keep``, and

    ``kind`` (``metadata`` or ``conversion``), ``record_id``, ``refers_to``, ``target_uri``, ``date``,
    ``payload_digest`` (of the response's payload), ``block_digest``, ``content_type``, ``block``, and
    ``record``, the whole record as it stands in a file. Null values of a response count as empty. Equal
    responses give equal records. Other columns are not read. The metadata block has the status line and all header fields
    of the source. ``all_references`` is that of :func:`plain_text`.
    """
    given = {n: F.coalesce(n, F.lit("")) for n in ("record_id", "target_uri", "date", "http_headers", "payload")}
    # A field may go on in lines that begin with white space.
    given["http_headers"] = F.regexp_replace(given["http_headers"], r"\r?\n[ \t]+", " ")
    text_id = record_id(F.lit("conversion"), F.col("record_id"), F.col("payload_digest"))
    about = [
        ("conversion", F.col("_text_id")),
        ("source-status", status_line(F.col("http_headers"))),
        ("source-content-type", header(F.col("http_headers"), "Content-Type")),
        ("source-content-length", header(F.col("http_headers"), "Content-Length")),
        ("source-payload-digest", F.col("payload_digest")),
        ("text-digest", digest(F.col("_text"))),
        ("text-characters", F.length("_text").cast("string")),
    ]
    fields = F.concat(*[F.concat(F.lit(f"{n}: "), value, F.lit(CRLF)) for n, value in about], other_headers(F.col("http_headers")))
    kinds = F.array(
        F.struct(
            F.lit("metadata").alias("kind"),
            record_id(F.lit("metadata"), F.col("record_id"), F.col("payload_digest")).alias("id"),
            F.lit("application/warc-fields").alias("content_type"),
            fields.alias("block"),
        ),
        F.struct(
            F.lit("conversion").alias("kind"),
            F.col("_text_id").alias("id"),
            F.lit("text/plain; charset=utf-8").alias("content_type"),
            F.col("_text").alias("block"),
        ),
    )
    records = (
        sources.select(*keep, *[column.alias(n) for n, column in given.items() if n not in keep])
        .withColumn("payload_digest", digest(F.col("payload")))
        .withColumns({"_text_id": text_id, "_text": plain_text(F.col("payload"), all_references)})
        .withColumn("_record", F.explode(kinds))
    )
    block = F.col("_record.block")
    lines = [
        ("WARC-Type", F.col("_record.kind")),
        ("WARC-Record-ID", F.col("_record.id")),
        ("WARC-Refers-To", F.col("record_id")),
        ("WARC-Target-URI", F.col("target_uri")),
        ("WARC-Date", F.col("date")),
        ("WARC-Payload-Digest", F.col("payload_digest")),
        ("WARC-Block-Digest", digest(block)),
        ("Content-Type", F.col("_record.content_type")),
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    head = [F.concat(F.lit(f"{n}: "), value, F.lit(CRLF)) for n, value in lines]
    return records.select(
        *keep,
        F.col("_record.kind").alias("kind"),
        F.col("_record.id").alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        "payload_digest",
        digest(block).alias("block_digest"),
        F.col("_record.content_type").alias("content_type"),
        block.alias("block"),
        F.concat(F.lit(f"{VERSION}{CRLF}"), *head, F.lit(CRLF), block, F.lit(CRLF * 2)).alias("record"),
    )
