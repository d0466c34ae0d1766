"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

Each response gives one metadata record (application/warc-fields: what the response's headers and page say) and one
conversion record (text/plain). Both refer to the response's record id, keep its target URI, date and payload digest, and
have ids that are a hash of that id and the record type, so that a repeated run makes the same records. Digests are
sha256 in the notation algorithm:value. All of it is row by row in built-in functions: nothing is shuffled.

HTML becomes text by these rules: comments and script, style, noscript, template and svg go with their
content, one that isn't closed with the rest of the page, as in browsers (so each costs one pass over the page); tags of blocks end a line, other tags vanish; the entities of ENTITIES are resolved once (others stay);
white space is collapsed, empty lines go.

The metadata record has the status code and every header line of the response as http-<name>: <value>, in their order,
names in lower case, folded lines as one; without a Content-Type that field stands empty.

Defined cases: null headers are none; a null body is empty and gives an empty conversion; a null URI is written as an empty field; repeated
rows give repeated records with the same ids, as the same response; an empty table gives no rows; extra columns of responses()
input are ignored, those of derivatives() pass through by name in `carry`, with an underscore after a name that the records have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: What vanishes with its content, tags that end a line, entities.
HIDDEN = r"(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z)|noscript\b.*?(?:</noscript\s*>|\z)|template\b.*?(?:</template\s*>|\z)|svg\b.*?(?:</svg\s*>|\z))"
BLOCK = r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|dl|dt|dd|tr|td|th|table|thead|tbody|section|article|aside|main|nav|header|footer|form|blockquote|pre|hr|title|head|body|html|figure|figcaption)\b[^>]*>"
TAG = r"<[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"))
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LANG = r"(?is)<html[^>]*\blang=[\"']?([A-Za-z-]+)"
CHARSET = r"(?is)<meta[^>]*\bcharset=[\"']?([A-Za-z0-9_-]+)"
LINK = r"(?i)<a\s[^>]*\bhref="
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(seed: Column) -> Column:
    h = F.sha2(seed.cast("binary"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x.cast("binary"), 256))


def clean(text: Column) -> Column:
    x = text
    for name, is_ in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(is_))
    # single spaces, the most of all, aren't matched
    x = F.regexp_replace(x, r"[\t\r\f\x0b][ \t\r\f\x0b]*| [ \t\r\f\x0b]+", " ")
    return F.trim(F.regexp_replace(x, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def _tags_replaced(text: Column, pattern: str, by: str) -> Column:
    """Tags end with >, so none is looked for after the last one: a page with many < and no > would be read once for each."""
    rest = F.substring_index(text, ">", -1)
    return F.concat(F.regexp_replace(F.left(text, F.length(text) - F.length(rest)), pattern, by), rest)


def plain_text(html: Column) -> Column:
    return clean(_tags_replaced(_tags_replaced(F.regexp_replace(html, HIDDEN, ""), BLOCK, "\n"), TAG, ""))


def responses(pages: DataFrame) -> DataFrame:
    """Response records of crawled pages: page_id, record_id, target_uri, date, http_headers, payload, payload_digest."""
    body, uri = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    seed = F.concat_ws(" ", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), uri)
    return pages.select("page_id", record_id(seed).alias("record_id"), uri.alias("target_uri"), F.lit(DATE).alias("date"), F.lit(HTTP).alias("http_headers"), body.alias("payload"), digest(body).alias("payload_digest"))


def _first(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1)


def _title(body: Column) -> Column:
    """Without an end tag there is none to look for."""
    return F.when(body.rlike("(?i)</title"), _first(body, TITLE)).otherwise("")


def _http_fields(headers: Column) -> Column:
    """The header lines after the status line, each as a line of warc-fields that follows another."""
    every = F.split(F.regexp_replace(headers, r"\r?\n[ \t]+", " "), r"\r?\n")
    lines = F.filter(every, lambda x: (F.trim(x) != "") & ~x.rlike("^HTTP/"))
    named = F.transform(lines, lambda x: F.concat(F.lit("\r\nhttp-"), F.lower(F.trim(F.substring_index(x, ":", 1))), F.lit(": "), F.regexp_extract(x, r"^[^:]*:[ \t]*([^\r\n]*)", 1)))
    return F.concat(F.when(headers.rlike(r"(?im)^content-type[ \t]*:"), F.lit("")).otherwise(F.lit("\r\nhttp-content-type: ")), F.array_join(named, ""))


def derivatives(records: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Two rows for each response: the carried columns, record_type, record_id, refers_to, target_uri, date, source_payload_digest, content_type, block, block_digest, content_length."""
    body, headers = F.col("payload"), F.coalesce("http_headers", F.lit(""))
    found = records.withColumn("_text", plain_text(body)).withColumn(
        "_meta",
        F.concat(
            F.lit("title: "), F.replace(clean(F.regexp_replace(_title(body), TAG, "")), F.lit("\n"), F.lit(" ")),
            F.lit("\r\nhttp-status: "), _first(headers, r"^HTTP/\S+ (\d{3})"), _http_fields(headers),
            F.lit("\r\nlanguage: "), F.lower(_first(body, LANG)),
            F.lit("\r\ncharset: "), F.lower(_first(body, CHARSET)),
            F.lit("\r\noutlinks: "), F.regexp_count(body, F.lit(LINK)).cast("string"),
            F.lit("\r\nsource-length: "), F.octet_length(body).cast("string"),
            F.lit("\r\nsource-payload-digest: "), F.col("payload_digest"),
            F.lit("\r\n"),
        ),
    )
    kind = lambda name, type_, block: F.struct(F.lit(name).alias("record_type"), F.lit(type_).alias("content_type"), block.alias("block"))
    both = F.array(kind("metadata", "application/warc-fields", F.col("_meta")), kind("conversion", "text/plain; charset=utf-8", F.col("_text")))
    kept = F.struct(F.lit(0), *(F.col(f"`{c}`") for c in carry)).alias("kept")
    rows = found.select(kept, F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("payload_digest").alias("source_payload_digest"), F.explode(both).alias("r"))
    own = {
        "record_type": F.col("r.record_type"), "record_id": record_id(F.concat_ws(" ", "r.record_type", "refers_to")), "refers_to": F.col("refers_to"), "target_uri": F.col("target_uri"), "date": F.col("date"),
        "source_payload_digest": F.col("source_payload_digest"), "content_type": F.col("r.content_type"), "block": F.col("r.block"), "block_digest": digest(F.col("r.block")), "content_length": F.octet_length("r.block").cast("long"),
    }
    return rows.select(*(F.col("kept")[c].alias(c + "_" * (c in own)) for c in carry), *(x.alias(c) for c, x in own.items()))


def serialized(records: DataFrame) -> Column:
    """A derivative record as it stands in a WARC file."""
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"), header("WARC-Type", F.col("record_type")), header("WARC-Record-ID", F.col("record_id")), header("WARC-Refers-To", F.col("refers_to")), header("WARC-Target-URI", F.col("target_uri")), header("WARC-Date", F.col("date")),
        header("WARC-Source-Payload-Digest", F.col("source_payload_digest")), header("WARC-Block-Digest", F.col("block_digest")), header("Content-Type", F.col("content_type")), header("Content-Length", F.col("content_length").cast("string")),
        F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n"),
    )
