"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response gives two records. The conversion holds the page's plain text, the metadata the
page's title, language and links together with the source's HTTP headers and digests. Both refer
to the response by id, URI and date, and the metadata names its conversion as concurrent. Record
ids are derived from the response's id, so a repeated task writes the same records. All of it is
column expressions; records can be rendered as WARC 1.1 and written as text or Parquet.

Defined cases: a null payload is an empty one and still gives both records; a null URI gives no
WARC-Target-URI line and null date no date lines; a page without a title, language or link has no
such line; an attribute may be quoted in either way or not at all, with blanks round its sign; links in
comments and scripts don't count; numeric entities and those of ENTITIES are resolved, in text, title,
language and links, others stay as written, and a number that is no character gives U+FFFD; unclosed tags, comments and scripts end with the page; repeated responses give repeated
records; an empty table gives an empty result; columns beyond the response's own are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.llm.registry import query

# Element names that end a line of text, and the entities that are resolved, in the order of resolution.
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"))
BASE32_DIGITS, BASE32_LETTERS = "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

HIDDEN = r"(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z)|noscript\b.*?(?:</noscript\s*>|\z))"
BLOCK_TAG = rf"(?i)</?(?:{BLOCKS})\b[^>]*(?:>|\z)"
BLANKS = r"(?: [ \t\r\x0B\f]|[\t\r\x0B\f])[ \t\r\x0B\f]*"  # runs that are not one plain blank already
OTHER_TAG = r"<[a-zA-Z/!?][^>]*(?:>|\z)"
TITLE = r"(?is)<title[^>]*>([^<]*)"
# An attribute's value in double quotes, single quotes or none; the quotes are taken off afterwards.
VALUE = r"""("[^">]*"|'[^'>]*'|[^\s"'>]+)"""
LANGUAGE = rf"(?i)<html\b[^>]*\slang\s*=\s*{VALUE}"
LINK = rf"(?i)<a\s(?:[^>]*?\s)?href\s*=\s*{VALUE}"
QUOTED = r"""^["'](.*)["']$"""
NUMERIC = r"^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"  # what follows &# in a numeric entity
CONVERSION_TYPE, METADATA_TYPE = "text/plain; charset=utf-8", "application/warc-fields"


def _resolved(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("&")), _named(F.when(F.contains(text, F.lit("&#")), _numbered(text)).otherwise(text))).otherwise(text)


def _named(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def _numbered(text: Column) -> Column:
    """Numeric entities as characters; an ampersand by number stays ``&amp;`` for the step that resolves it last."""
    def character(after: Column) -> Column:
        digits = F.regexp_extract(after, NUMERIC, 1)
        code = F.when(F.lower(digits).startswith("x"), F.conv(F.substr(digits, F.lit(2)), 16, 10)).otherwise(digits).cast("bigint")
        valid = (code > 0) & ~code.between(0xD800, 0xDFFF) & (code <= 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        whole = F.concat(F.when(code == 38, F.lit("&amp;")).otherwise(char), F.substr(after, F.length(digits) + 2))
        return F.when(digits == "", F.concat(F.lit("&#"), after)).otherwise(whole)

    parts = F.split(text, "&#", -1)
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), character), ""))


def shown(html: Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(html, HIDDEN, "")


def _attribute(value: Column) -> Column:
    return _resolved(F.regexp_replace(value, QUOTED, "$1"))


def plain_text(html: Column) -> Column:
    """Visible text: block elements end lines, blanks are joined, empty lines dropped, entities resolved."""
    return _text_of(shown(html))


def _text_of(page: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(page, BLOCK_TAG, "\n"), OTHER_TAG, "")
    joined = F.regexp_replace(F.regexp_replace(bare, BLANKS, " "), r" ?\n[ \n]*", "\n")
    return _resolved(F.btrim(joined, F.lit(" \n")))


def digest(content: Column) -> Column:
    """``sha1:`` and the Base32 form of the digest; twenty bits at a time make four letters."""
    hexed = F.sha1(content.cast("binary"))
    letters = [F.lpad(F.lower(F.conv(F.substring(hexed, i, 5), 16, 32)), 4, "0") for i in range(1, 41, 5)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*letters), BASE32_DIGITS, BASE32_LETTERS))


def record_id(*parts: Column) -> Column:
    """A URN in the form of a UUID, from the parts' MD5."""
    h = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    cuts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value))


def derive(responses: DataFrame) -> DataFrame:
    """Two rows per response of (record_id, target_uri, date, http_headers, payload), the last four nullable strings.

    Result: record_id, warc_type, refers_to, refers_to_uri, refers_to_date, concurrent_to, content_type,
    source_headers, source_digest, block_digest, content_length, header, content.
    """
    responses = responses.withColumn("__html", F.coalesce(F.col("payload").cast("string"), F.lit(""))).withColumn("__shown", shown(F.col("__html")))
    html, page = F.col("__html"), F.col("__shown")
    title = F.trim(F.regexp_replace(_resolved(F.regexp_extract(html, TITLE, 1)), r"\s+", " "))
    links = F.regexp_extract_all(page, F.lit(LINK), F.lit(1))
    source = responses.select(
        F.col("record_id").alias("refers_to"), F.col("target_uri").alias("refers_to_uri"), F.col("date").alias("refers_to_date"),
        F.col("http_headers").alias("source_headers"), digest(html).alias("source_digest"), _text_of(page).alias("__plain"),
        F.array_join(F.array_compact(F.array(
            _field("title", F.nullif(title, F.lit(""))), _field("language", F.nullif(_attribute(F.regexp_extract(page, LANGUAGE, 1)), F.lit(""))),
            _field("source-payload-digest", digest(html)), _field("source-payload-length", F.octet_length(html).cast("string")),
        )), "\r\n").alias("__facts"),
        F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), _attribute(x))), "\r\n").alias("__links"),
        F.array_join(F.transform(F.filter(F.split(F.coalesce("http_headers", F.lit("")), "\r\n"), lambda x: x != ""), lambda x: F.concat(F.lit("source-header: "), x)), "\r\n").alias("__headers"),
        record_id(F.lit("conversion"), F.col("record_id")).alias("__conversion"), record_id(F.lit("metadata"), F.col("record_id")).alias("__metadata"),
    )
    facts = F.concat(F.array_join(F.filter(F.array("__facts", "__headers", "__links"), lambda x: x != ""), "\r\n"), F.lit("\r\n"))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.col("__metadata").alias("record_id"), F.col("__conversion").alias("concurrent_to"), F.lit(METADATA_TYPE).alias("content_type"), facts.alias("content")),
        F.struct(F.lit("conversion").alias("warc_type"), F.col("__conversion").alias("record_id"), F.lit(None).cast("string").alias("concurrent_to"), F.lit(CONVERSION_TYPE).alias("content_type"), F.col("__plain").alias("content")),
    )
    shared = ["refers_to", "refers_to_uri", "refers_to_date", "source_headers", "source_digest"]
    rows = source.select(*shared, F.inline(kinds))
    rows = rows.withColumns({"block_digest": digest(F.col("content")), "content_length": F.octet_length("content").cast("bigint")})
    lines = F.array(
        F.lit("WARC/1.1"), _field("WARC-Type", F.col("warc_type")), _field("WARC-Record-ID", F.col("record_id")), _field("WARC-Date", F.col("refers_to_date")),
        _field("WARC-Target-URI", F.col("refers_to_uri")), _field("WARC-Refers-To", F.col("refers_to")), _field("WARC-Refers-To-Target-URI", F.col("refers_to_uri")),
        _field("WARC-Refers-To-Date", F.col("refers_to_date")), _field("WARC-Concurrent-To", F.col("concurrent_to")), _field("WARC-Block-Digest", F.col("block_digest")),
        _field("Content-Type", F.col("content_type")), _field("Content-Length", F.col("content_length").cast("string")),
    )
    header = F.array_join(F.array_compact(lines), "\r\n")
    return rows.select("record_id", "warc_type", "refers_to", "refers_to_uri", "refers_to_date", "concurrent_to", "content_type", "source_headers", "source_digest",
                       "block_digest", "content_length", header.alias("header"), "content")


def rendered(records: DataFrame) -> DataFrame:
    """One column ``record``: the records in WARC 1.1 form, ready for a text or binary sink."""
    return records.select(F.concat(F.col("header"), F.lit("\r\n\r\n"), F.col("content"), F.lit("\r\n\r\n")).alias("record"))


def page_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Raw pages (page_id, url, html) as the response records a crawl at ``date`` would hold."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n"))
    ident = record_id(F.lit("response"), F.col("page_id").cast("string"), F.col("url"))
    return pages.select(ident.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), html.alias("payload"))


def _resolved_sql(text: str) -> str:
    digits = f"regexp_extract(p, '{NUMERIC}', 1)"
    code = f"(CASE WHEN lower({digits}) LIKE 'x%' THEN ('0x' || substr({digits}, 2))::BIGINT ELSE {digits}::BIGINT END)"
    char = f"CASE WHEN {code} = 38 THEN '&amp;' WHEN {code} = 0 OR {code} BETWEEN 55296 AND 57343 OR {code} > 1114111 THEN chr(65533) ELSE chr({code}::INTEGER) END"
    parts = f"string_split({text}, '&#')"
    text = f"({parts}[1] || array_to_string(list_transform({parts}[2:], lambda p: CASE WHEN {digits} = '' THEN '&#' || p ELSE {char} || substr(p, length({digits}) + 2) END), ''))"
    for name, char in ENTITIES:
        text = f"replace({text}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return text


def _digest_sql(content: str) -> str:
    letters = " || ".join(f"to_base(('0x' || substr(sha1({content}), {i}, 5))::BIGINT, 32, 4)" for i in range(1, 41, 5))
    return f"'sha1:' || translate(lower({letters}), '{BASE32_DIGITS}', '{BASE32_LETTERS}')"


def _id_sql(*parts: str) -> str:
    h = f"md5(concat_ws(chr(10), {', '.join(parts)}))"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


def _header_sql() -> str:
    names = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "refers_to_date"), ("WARC-Target-URI", "refers_to_uri"), ("WARC-Refers-To", "refers_to"),
             ("WARC-Refers-To-Target-URI", "refers_to_uri"), ("WARC-Refers-To-Date", "refers_to_date"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Block-Digest", "block_digest"),
             ("Content-Type", "content_type"), ("Content-Length", "content_length::VARCHAR"))
    return "concat_ws(chr(13) || chr(10), 'WARC/1.1', " + ", ".join(f"'{n}: ' || {c}" for n, c in names) + ")"


def _attribute_sql(value: str) -> str:
    return _resolved_sql(f"regexp_replace({value}, '{_quoted(QUOTED)}', '\\1')")


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


OP1_SQL = f"""
WITH page AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
response AS (SELECT *, {_id_sql("'response'", "page_id::VARCHAR", "url")} AS refers_to,
  'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) AS source_headers FROM page),
shown AS (SELECT *, regexp_replace(html, '{HIDDEN}', '', 'g') AS page FROM response),
bare AS (SELECT *, regexp_replace(regexp_replace(page, '{BLOCK_TAG}', chr(10), 'g'), '{OTHER_TAG}', '', 'g') AS b FROM shown),
facts AS (SELECT *, {_digest_sql('html')} AS source_digest, trim(regexp_replace({_resolved_sql(f"regexp_extract(html, '{TITLE}', 1)")}, '\\s+', ' ', 'g')) AS title,
  {_attribute_sql(f"regexp_extract(page, '{_quoted(LANGUAGE)}', 1)")} AS language, list_transform(regexp_extract_all(page, '{_quoted(LINK)}', 1), lambda v: {_attribute_sql("v")}) AS links,
  {_resolved_sql("trim(regexp_replace(regexp_replace(b, '" + BLANKS + r"', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))")} AS plain FROM bare),
records AS (
  SELECT refers_to, url AS refers_to_uri, '2024-01-01T00:00:00Z' AS refers_to_date, source_headers, source_digest, 'metadata' AS warc_type, {_id_sql("'metadata'", 'refers_to')} AS record_id,
    {_id_sql("'conversion'", 'refers_to')} AS concurrent_to, '{METADATA_TYPE}' AS content_type,
    concat_ws(chr(13) || chr(10), 'title: ' || nullif(title, ''), 'language: ' || nullif(language, ''), 'source-payload-digest: ' || source_digest, 'source-payload-length: ' || strlen(html),
      array_to_string(list_transform(list_filter(string_split(source_headers, chr(13) || chr(10)), lambda x: x <> ''), lambda x: 'source-header: ' || x), chr(13) || chr(10)),
      nullif(array_to_string(list_transform(links, lambda x: 'outlink: ' || x), chr(13) || chr(10)), '')) || chr(13) || chr(10) AS content FROM facts
  UNION ALL
  SELECT refers_to, url, '2024-01-01T00:00:00Z', source_headers, source_digest, 'conversion', {_id_sql("'conversion'", 'refers_to')}, NULL, '{CONVERSION_TYPE}', plain FROM facts),
digested AS (SELECT *, {_digest_sql('content')} AS block_digest, strlen(content)::BIGINT AS content_length FROM records)
SELECT *, {_header_sql()} AS header FROM digested
"""


@query("op1_warc_derivatives", OP1_SQL)
def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(page_responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
