r"""WARC derivatives: from response records, a linked metadata record and a plain-text conversion record each.

Both refer to their response (WARC-Refers-To) and keep its target URI and date. The metadata record
(application/warc-fields) carries the source's HTTP status line and headers, its block and payload digests and the number of
links; the conversion record carries the text of the payload. Record ids are name-based: the same response always gives the
same derivatives, so a part that is computed again after a loss gives no second record. Everything is a column expression:
one pass over the responses, no shuffle.

Text of a payload: scripts, styles, templates and comments go, to the end where they are not closed; block-level tags end a line,
other tags vanish; decimal and hexadecimal character references and the names of HTML 4 and XML are decoded, others stay as they
are; runs of blanks become one space, runs of line ends one line feed. A tag has no < within; a < that no > follows before
the next < is text. So every pattern passes over a text once, whatever stands in it.

Defined cases: null block counts as empty (its conversion is an empty text); a block without an empty line is all header;
null url, date or id give empty fields (and ids made from them); repeated responses give repeated records; an empty table
gives none; very long blocks are taken whole, in time that grows as their length; other columns are ignored.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.vectors import let
from quillon.llm.common import table

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"  # pages have no date of capture

#: Steps from HTML to text, fixed values: (pattern, replacement), in this order. Java and RE2 read them alike.
STEPS = (
    (r"(?is)<script\b[^<>]*>.*?(?:</script\s*>|\z)", " "),
    (r"(?is)<style\b[^<>]*>.*?(?:</style\s*>|\z)", " "),
    (r"(?is)<template\b[^<>]*>.*?(?:</template\s*>|\z)", " "),
    (r"(?s)<!--.*?(?:-->|\z)", " "),
    (r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^<>]*>", "\n"),
    (r"<[a-zA-Z/!?][^<>]*>", ""),
)
NAMED = {**name2codepoint, "apos": 39}
REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,9});"
BLANKS = ((r"[ \t\f\x{0B}\x{A0}]+", " "), (r" ?[\r\n][ \r\n]*", "\n"), (r"^[ \n]+|[ \n]+$", ""))


def plain_text(html: Column) -> Column:
    out = html
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to)
    out = let(out, _decoded)
    for pattern, to in BLANKS:
        out = F.regexp_replace(out, pattern, to)
    return out


def _decoded(text: Column) -> Column:
    """Character references as their characters; what is none, or none that Unicode has, stays. Texts without any are not touched."""
    names = F.create_map(*[F.lit(x) for item in sorted(NAMED.items()) for x in item])

    def code(ref: Column) -> Column:
        hexadecimal = F.conv(F.substring(ref, 3, 9), 16, 10).try_cast("int")
        number = F.when(F.lower(F.substring(ref, 2, 1)) == "x", hexadecimal).otherwise(F.substring(ref, 2, 9).try_cast("int"))
        return F.when(ref == "", F.lit(0)).when(F.startswith(ref, F.lit("#")), number).otherwise(F.try_element_at(names, ref))

    def replaced(part: Column, ref: Column, n: Column) -> Column:
        valid = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(valid, F.concat(char, F.substr(part, F.length(ref) + 2))).otherwise(F.concat(F.lit("&"), part))

    one = lambda part: let(F.regexp_extract(part, REFERENCE, 1), lambda ref: let(code(ref), lambda n: replaced(part, ref, n)))
    joined = lambda parts: F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts) - 1), one), ""))
    return F.when(F.contains(text, F.lit("&")), let(F.split(text, "&"), joined)).otherwise(text)


def digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x.cast("binary"), 256))


def record_id(name: Column) -> Column:
    """A name-based urn:uuid of version 8: the first 122 free bits of the name's SHA-256."""
    h = F.sha2(name.cast("binary"), 256)
    piece = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), piece(1, 8), F.lit("-"), piece(9, 4), F.lit("-8"), piece(14, 3), F.lit("-a"), piece(18, 3), F.lit("-"), piece(21, 12), F.lit(">"))


def responses_from_pages(pages: DataFrame) -> DataFrame:
    """Response records (HTTP header and body) for raw pages; their ids are made from page_id and url."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF * 2))
    return pages.select(
        "page_id",
        record_id(F.concat(F.lit("response "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), url)).alias("record_id"),
        url.alias("target_uri"), F.lit(DATE).alias("warc_date"), F.concat(head, html).alias("block"),
    )


def derive(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """responses(record_id, target_uri, warc_date, block) -> metadata and conversion records, two for each response.

    Columns: keep, warc_type, record_id, refers_to, target_uri, warc_date, content_type, content_length, block_digest,
    source_block_digest, source_payload_digest, source_headers, block.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    at = F.locate(CRLF * 2, F.col("block"))
    r = responses.select(*keep, text("record_id").alias("source_id"), text("target_uri").alias("target_uri"), text("warc_date").alias("warc_date"), text("block").alias("block"))
    r = r.withColumn("headers", F.when(at > 0, F.substring(F.col("block"), F.lit(1), at - 1)).otherwise(F.col("block"))).withColumn("payload", F.when(at > 0, F.substr("block", at + 4)).otherwise(""))
    r = r.withColumn("source_block_digest", digest(F.col("block"))).withColumn("source_payload_digest", digest(F.col("payload")))
    links = F.regexp_count("payload", F.lit(r"(?i)<a\b[^<>]*\bhref\s*="))
    about = F.concat(
        F.lit("source-block-digest: "), F.col("source_block_digest"), F.lit(f"{CRLF}source-payload-digest: "), F.col("source_payload_digest"),
        F.lit(f"{CRLF}outlinks: "), links.cast("string"), F.lit(f"{CRLF}source-header: "), F.replace(F.col("headers"), F.lit(CRLF), F.lit(f"{CRLF}source-header: ")), F.lit(CRLF),
    )
    made = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), about.alias("made")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("payload")).alias("made")),
    )
    r = r.select(*keep, "source_id", "target_uri", "warc_date", "headers", "source_block_digest", "source_payload_digest", F.explode(made).alias("m"))
    return r.select(
        *keep, "m.warc_type", record_id(F.concat_ws(" ", F.col("m.warc_type"), F.col("source_id"))).alias("record_id"), F.col("source_id").alias("refers_to"), "target_uri", "warc_date",
        "m.content_type", F.octet_length("m.made").cast("long").alias("content_length"), digest(F.col("m.made")).alias("block_digest"), "source_block_digest", "source_payload_digest",
        F.col("headers").alias("source_headers"), F.col("m.made").alias("block"),
    )


def record(of: DataFrame) -> Column:
    """A derivative as a WARC/1.1 record without the two line ends that close it."""
    fields = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("Content-Type", "content_type"), ("WARC-Block-Digest", "block_digest"), ("Content-Length", "content_length"))
    return F.concat(F.lit("WARC/1.1" + CRLF), *[F.concat(F.lit(f"{name}: "), of[c].cast("string"), F.lit(CRLF)) for name, c in fields], F.lit(CRLF), of["block"])


def write_warc(derivatives: DataFrame, path: str, compression: str = "gzip") -> None:
    """One WARC file for each partition, in any file system that Spark writes."""
    derivatives.select(record(derivatives).alias("value")).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both derivatives of every page's response."""
    return derive(responses_from_pages(table(spark, sf_dir, "pages")), keep=("page_id",))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    text = "payload"
    for pattern, to in STEPS:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(to)}, 'g')"
    ref = f"regexp_extract(p, {quote(REFERENCE)}, 1)"
    names = "map {" + ", ".join(f"'{k}': {v}" for k, v in sorted(NAMED.items())) + "}"
    code = f"""coalesce(case when lower(substr({ref}, 2, 1)) = 'x' and {ref}[1] = '#' then ('0x' || substr({ref}, 3))::int when {ref}[1] = '#' then try_cast(substr({ref}, 2) as int) else {names}[{ref}] end, 0)"""
    text = f"""list_aggregate(list_transform(string_split({text}, '&'), lambda p, i: case when i = 1 then p
        when {ref} <> '' and {code} between 1 and 1114111 and {code} not between 55296 and 57343 then chr({code}) || substr(p, length({ref}) + 2) else '&' || p end), 'string_agg', '')"""
    for pattern, to in BLANKS:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(to)}, 'g')"
    uid = lambda name: (h := f"sha256({name})") and f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-8' || substr({h}, 14, 3) || '-a' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>'"
    return f"""
with r as (select page_id, coalesce(url, '') as target_uri, coalesce(html, '') as payload,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) as source_headers from pages),
s as (select *, {uid("'response ' || coalesce(page_id::varchar, '') || ' ' || target_uri")} as refers_to,
    'sha256:' || sha256(source_headers || chr(13) || chr(10) || chr(13) || chr(10) || payload) as source_block_digest, 'sha256:' || sha256(payload) as source_payload_digest from r),
m as (select *, 'metadata' as warc_type, 'application/warc-fields' as content_type,
    'source-block-digest: ' || source_block_digest || chr(13) || chr(10) || 'source-payload-digest: ' || source_payload_digest || chr(13) || chr(10) || 'outlinks: '
    || len(regexp_extract_all(payload, '(?i)<a\\b[^<>]*\\bhref\\s*=')) || chr(13) || chr(10) || 'source-header: ' || replace(source_headers, chr(13) || chr(10), chr(13) || chr(10) || 'source-header: ') || chr(13) || chr(10) as block from s
    union all select *, 'conversion', 'text/plain; charset=utf-8', {text} from s)
select page_id, warc_type, {uid("warc_type || ' ' || refers_to")} as record_id, refers_to, target_uri, '{DATE}' as warc_date, content_type, octet_length(encode(block))::bigint as content_length,
    'sha256:' || sha256(block) as block_digest, source_block_digest, source_payload_digest, source_headers, block from m
"""


QUERIES = {"op6_warc_derivatives": op6_warc_derivatives}
ORACLES = {"op6_warc_derivatives": _sql()}
