"""WARC derivative builder: from each response record a metadata record and a plain-text conversion record.

Both refer to the response by WARC-Refers-To, keep its target URI, date and payload digest, and carry the source's
HTTP headers (metadata in its fields, conversion by the link). Everything is column expressions in one pass over the
responses, without a shuffle. read_warc() takes records by their Content-Length, captured() the responses among them;
write_warc() writes text files.

Defined results: a null payload counts as empty and yields an empty text; a null url is an empty target URI; repeated
responses give equal records with equal identifiers; a very long page is one value and derived whole; an empty table
gives an empty result; other columns, whatever their names, are dropped; damaged records are defined at parse_warc().
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator
from html import unescape
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrillo.llm.common import table
from corrillo.llm.urls import crawl_time

CRLF = "\r\n"
SCRIPTS = r"(?is)<(script|style)(\s[^>]*)?>.*?</(script|style)>"
COMMENTS = r"(?s)<!--.*?-->"
BLOCKS = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|title|head|body|html)(\s[^>]*)?/?>"
TAGS = r"<[^>]*>"
SPACES, BREAKS, ENDS = r"[ \t\r\f]+", r" ?\n[ \n]*", r"^[ \n]+|[ \n]+$"
TITLE, LANG = r"(?is)<title[^>]*>(.*?)</title>", r"(?i)<html[^>]*\slang=\"([^\"]*)\""
LINKS = r"(?i)<a\s[^>]*href=\"([^\"]*)\""
#: A character reference of HTML 5: numeric, or a name that may run into what follows it.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Names that need no semicolon, the longest first.
OPEN_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
#: Names and characters, the commonest first (a map is searched from its start); a hard space counts as a blank.
NAMES = {n: html5[n].replace("\xa0", " ") for n in ("amp;", "lt;", "gt;", "quot;", "copy;", "middot;", "nbsp;", *html5)}
#: Code points that stand for something else than their character, by html.unescape; U+FEFF would be read as a byte order mark.
NUMBERS = {str(n): unescape(f"&#{n};").replace("\xa0", " ") for n in (*range(0xA1), *range(0xFDD0, 0xFDF0), 0xFEFF, *(p * 0x10000 + n for p in range(17) for n in (0xFFFE, 0xFFFF)))}
UNKNOWN = "\ufffd"
DERIVED = "metadata", "conversion"


def lookup(of: dict[str, str]) -> Column:
    """A map as one literal."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in of.items())), F.lit("\x02"), F.lit("\x01"))


def numbered(reference: Column) -> Column:
    """The character of a numeric reference."""
    digits = F.regexp_extract(reference, r"^&#[xX]?0*([0-9a-fA-F]*)", 1)
    base = lambda n: F.conv(digits, n, 10)
    point = F.when(digits == "", F.lit("0")).when(reference.rlike("^&#[xX]"), base(16)).otherwise(base(10))
    number = point.cast("long")
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    wrong = (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    return F.when(F.length(digits) > 7, F.lit(UNKNOWN)).when(wrong, F.lit(UNKNOWN)).otherwise(F.coalesce(F.try_element_at(lookup(NUMBERS), point), char))


def named(reference: Column) -> Column:
    """The characters of a named reference; of an unknown name, those of the longest known start of it."""
    name = F.regexp_extract(reference, f"^&({OPEN_NAMES})", 1)
    start = F.when(name == "", reference).otherwise(F.concat(F.try_element_at(lookup(NAMES), name), F.substring(reference, F.length(name) + 2, F.length(reference))))
    return F.coalesce(F.try_element_at(lookup(NAMES), F.substring(reference, F.lit(2), F.length(reference))), start)


def unescaped(text: Column) -> Column:
    """All named and numeric character references decoded once, as html.unescape does."""

    def whole(t: Column) -> Column:
        pairs = F.arrays_zip(F.split(t, REFERENCE, -1).alias("b"), F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0)).alias("r"))
        decoded = F.transform(pairs, lambda p: F.concat(p.b, F.when(p.r.isNull(), F.lit("")).when(p.r.startswith("&#"), numbered(p.r)).otherwise(named(p.r))))
        return F.when(F.contains(t, F.lit("&")), F.array_join(decoded, "")).otherwise(t)

    # within a lambda the text is computed once
    return F.get(F.transform(F.array(text), whole), F.lit(0))


def plain_text(html: Column) -> Column:
    """The text of a page: no scripts, styles, comments or tags; a line per block."""
    for pattern, by in ((SCRIPTS, ""), (COMMENTS, ""), (BLOCKS, "\n"), (TAGS, "")):
        html = F.regexp_replace(html, pattern, by)
    text = unescaped(html)
    for pattern, by in ((SPACES, " "), (BREAKS, "\n"), (ENDS, "")):
        text = F.regexp_replace(text, pattern, by)
    return text


def record_id(*parts: Column | str) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts)), F.lit(">"))


def responses(pages: DataFrame) -> DataFrame:
    """Response records of fetched pages: page_id, record_id, target_uri, warc_date, http (headers, blank line, payload)."""
    html = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"))
    return pages.select(
        "page_id",
        record_id(F.lit("response"), F.col("page_id").cast("string"), "url").alias("record_id"),
        F.coalesce("url", F.lit("")).alias("target_uri"),
        F.date_format(crawl_time(F.col("page_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("warc_date"),
        F.concat(head, F.lit(CRLF * 2), html).alias("http"),
    )


def captured(records: DataFrame) -> DataFrame:
    """Response records as read_warc() gives them, in the columns of responses(); page_id is null, as WARC has none.

    Records of other types are left out; bytes that are not UTF-8 become replacement characters; without a record id a
    record is known by its target, date and block.
    """
    http = F.make_valid_utf8(F.coalesce("block", F.lit(b"")).cast("string"))
    made = record_id(F.lit("response"), "target_uri", "warc_date", F.md5("block"))
    return records.where("lower(record_type) = 'response'").select(
        F.lit(None).cast("long").alias("page_id"), F.coalesce("record_id", made).alias("record_id"),
        F.coalesce("target_uri", F.lit("")).alias("target_uri"), F.coalesce("warc_date", F.lit("")).alias("warc_date"), http.alias("http"))


def derive(found: DataFrame) -> DataFrame:
    """Two records of each response, with the columns of a WARC header and the block."""
    http = F.coalesce("http", F.lit(""))
    at = F.locate(CRLF * 2, http)
    split = found.withColumns({
        "source_headers": F.when(at > 0, F.substring(http, F.lit(1), at - 1)).otherwise(F.lit("")),
        "payload": F.when(at > 0, F.substring(http, at + 4, F.length(http))).otherwise(http),
    })
    body = split.withColumns({
        "payload_digest": F.concat(F.lit("sha256:"), F.sha2("payload", 256)),
        "text": plain_text(F.col("payload")),
        "links": F.regexp_extract_all("payload", F.lit(LINKS), 1),
        "title": F.trim(F.regexp_replace(unescaped(F.regexp_extract("payload", TITLE, 1)), r"[ \t\r\n\f]+", " ")),
        "lang": F.regexp_extract("payload", LANG, 1),
    })
    fields = F.concat(
        F.lit("title: "), F.col("title"), F.lit(f"{CRLF}language: "), F.col("lang"), F.lit(f"{CRLF}sourcePayloadDigest: "), F.col("payload_digest"), F.lit(CRLF),
        F.array_join(F.transform(F.filter(F.split("source_headers", CRLF), lambda h: h != ""), lambda h: F.concat(F.lit("sourceHeader: "), h, F.lit(CRLF))), ""),
        F.array_join(F.transform("links", lambda u: F.concat(F.lit("outlink: "), u, F.lit(CRLF))), ""),
    )
    records = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    return body.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "payload_digest", F.size("links").cast("long").alias("n_outlinks"), F.explode(records).alias("r")).select(
        "page_id", "r.record_type", record_id("r.record_type", "refers_to").alias("record_id"), "refers_to", "target_uri", "warc_date", "r.content_type",
        F.octet_length("r.block").cast("long").alias("content_length"), F.concat(F.lit("sha256:"), F.sha2("r.block", 256)).alias("block_digest"), "payload_digest", "n_outlinks", "r.block",
    )


def write_warc(records: DataFrame, path: str) -> None:
    """WARC/1.1 files of derived records, gzipped; the last line break of a record is the sink's own."""
    named = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("Content-Type", "content_type"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Length", "content_length"))
    head = F.concat(F.lit(f"WARC/1.1{CRLF}"), *(F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit(CRLF)) for name, c in named))
    records.select(F.concat(head, F.lit(CRLF), F.col("block"), F.lit(CRLF))).write.option("lineSep", CRLF).option("compression", "gzip").text(path)


class Cursor:
    """Bytes from a file that is opened piece by piece; gzip members, of which a WARC file has one a record, follow each other."""

    def __init__(self, content: bytes) -> None:
        self.file = gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)

    def line(self) -> bytes:
        return self._safe(self.file.readline)

    def take(self, size: int) -> bytes:
        return self._safe(lambda: self.file.read(size))

    @staticmethod
    def _safe(read) -> bytes:
        """What a cut off or damaged member still gives is nothing."""
        try:
            return read()
        except (EOFError, gzip.BadGzipFile, zlib.error):
            return b""


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record, by Content-Length; one record is in memory at a time.

    What is not a record is skipped up to the next line that begins one. A record cut off at the end of the file gives
    what is there; one without a readable length has an empty block. Both say so by a header `x-problem`.
    """
    cursor = Cursor(content)
    while line := cursor.line():
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        while (line := cursor.line()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = headers.get("content-length", "")
        size = int(length) if length.isascii() and length.isdigit() else 0
        block = cursor.take(size)
        if not line:
            headers["x-problem"] = "headers cut off"
        elif not length.isdigit():
            headers["x-problem"] = "no length"
        elif len(block) < size:
            headers["x-problem"] = "block cut off"
        yield headers, block


READ = ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type", "x-problem")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_type, record_id, refers_to, target_uri, warc_date, content_type, problem and block of the records of WARC files, gzipped or not.

    A task holds one file as it is stored (they are customarily cut at 1 GB) and one record opened.
    """
    columns = ["record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "problem", "block"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                for headers, block in parse_warc(content):
                    yield pd.DataFrame([(*map(headers.get, READ), block)], columns=columns)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, ", ".join(f"{c} string" for c in columns[:-1]) + ", block binary")


def op10_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages")))


def _sql_plain(x: str) -> str:
    for pattern, by in ((SCRIPTS, "''"), (COMMENTS, "''"), (BLOCKS, "chr(10)"), (TAGS, "''")):
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    x = _sql_unescaped(x)
    for pattern, by in ((SPACES, "' '"), (BREAKS, "chr(10)"), (ENDS, "''")):
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    return x


def _sql_unescaped(x: str) -> str:
    """Named references with a semicolon and numeric ones, each by itself; open and quirky ones, which no page of the tables has, stay as they are."""
    one = "CASE WHEN r ~ '&#[xX][0-9a-fA-F]+;' THEN chr(CAST('0x' || r[4:-2] AS INTEGER)) WHEN r ~ '&#[0-9]+;' THEN chr(CAST(r[3:-2] AS INTEGER)) ELSE coalesce(names[r[2:]], r) END"
    pattern = "'&#[xX][0-9a-fA-F]{1,5};|&#[0-9]{1,6};|&[A-Za-z][A-Za-z0-9]*;'"
    between, found = f"string_split_regex({x}, {pattern})", f"regexp_extract_all({x}, {pattern})"
    return f"replace(array_to_string(list_transform(list_zip({between}, list_transform({found}, lambda r: {one})), lambda p: p[1] || coalesce(p[2], '')), ''), chr(160), ' ')"


def _sql_id(x: str) -> str:
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr(md5({x}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


OP10_SQL = f"""
WITH entities AS (SELECT MAP {{{", ".join(f"'{n}': '{c.replace(chr(39), chr(39) * 2)}'" for n, c in NAMES.items() if n.endswith(";"))}}} AS names),
source AS (
    SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html,
           {_sql_id("concat_ws('|', 'response', CAST(page_id AS VARCHAR), url)")} AS refers_to,
           strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(((page_id % 8784) + 8784) % 8784 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') AS warc_date
    FROM pages),
body AS (
    SELECT *, 'sha256:' || sha256(html) AS payload_digest, {_sql_plain("html")} AS text, regexp_extract_all(html, '{LINKS}', 1) AS links,
           trim(regexp_replace({_sql_unescaped(f"regexp_extract(html, '{TITLE}', 1)")}, '[ \\t\\r\\n\\f]+', ' ', 'g')) AS title, regexp_extract(html, '{LANG}', 1) AS lang
    FROM source, entities),
blocks AS (
    SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
           'title: ' || title || chr(13) || chr(10) || 'language: ' || lang || chr(13) || chr(10) || 'sourcePayloadDigest: ' || payload_digest || chr(13) || chr(10)
           || 'sourceHeader: HTTP/1.1 200 OK' || chr(13) || chr(10) || 'sourceHeader: Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
           || 'sourceHeader: Content-Length: ' || strlen(html) || chr(13) || chr(10)
           || coalesce(array_to_string([('outlink: ' || u || chr(13) || chr(10)) FOR u IN links], ''), '') AS block
    FROM body
    UNION ALL
    SELECT *, 'conversion', 'text/plain; charset=utf-8', text FROM body)
SELECT page_id, record_type, {_sql_id("concat_ws('|', record_type, refers_to)")} AS record_id, refers_to, target_uri, warc_date, content_type,
       CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, payload_digest, CAST(len(links) AS BIGINT) AS n_outlinks, block
FROM blocks
"""
