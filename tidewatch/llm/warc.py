"""WARC derivatives: linked metadata and plain-text conversion records of responses.

Each response record gives a metadata record (what its headers and page say, as JSON) and a conversion record
(its text), both of which name the response in WARC-Refers-To and carry its target, date and digests. Files
are read and written record by record; the conversion itself is made of DataFrame functions.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import map_batches, table

SPACES = r"[ \t\r\f\x0B\x{A0}]+"
#: References for the characters that HTML itself reserves, and the space.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"


def html_text(html: Column) -> Column:
    """The text of a page: no scripts, styles or comments, block elements on lines of their own, white space folded."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    out = F.regexp_replace(out, r"\s+", " ")
    out = F.regexp_replace(out, rf"(?i)</?(?:{BLOCKS})(?:\s[^>]*)?/?>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for name, sign in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    out = F.regexp_replace(out, r" *\n[ \n]*", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"^[ \n]+|[ \n]+$", ""), r" +", " ")


def record_id(*parts: Column) -> Column:
    """A record id that the same parts always give."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def digest(body: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def derive(responses: DataFrame) -> DataFrame:
    """Records (record_id, warc_type, target_uri, date, refers_to, refers_to_digest, payload_digest, content_type, content) from responses.

    responses has record_id, target_uri, date, http_headers and body (text); each gives one metadata and one
    conversion record, also if its body is null or empty (then the content is empty too, and the digest is
    that of nothing). A response without a record id gets no derivatives, as nothing could refer to it.
    Repeated responses give repeated records with the same ids. Where the columns are there, the source's own
    source_digest (its WARC-Payload-Digest) is kept, and else the digest is that of the bytes raw_body; block_digest and
    warc_headers go into the metadata. Other columns are left out.
    """
    body = F.coalesce("body", F.lit(""))
    source = digest(F.coalesce("raw_body", body.cast("binary")) if "raw_body" in responses.columns else body)
    if "source_digest" in responses.columns:
        source = F.coalesce("source_digest", source)
    length = F.coalesce(F.octet_length("raw_body"), F.octet_length(body)) if "raw_body" in responses.columns else F.octet_length(body)
    kept = [c for c in ("block_digest", "warc_headers") if c in responses.columns]
    base = responses.where("record_id is not null").select("record_id", "target_uri", "date", "http_headers", body.alias("body"), source.alias("source"), length.alias("length"), *kept)
    base = base.withColumns({
        "text": html_text(F.col("body")),
        "title": html_text(F.regexp_extract("body", r"(?is)<title[^>]*>(.*?)</title", 1)),
        "lang": F.regexp_extract("body", r"(?i)<html[^>]*\slang=[\"']?([A-Za-z-]+)", 1),
        "links": F.regexp_extract_all("body", F.lit(r"(?i)<a\s[^>]*?href=[\"']([^\"'>]*)"), F.lit(1)),
    })
    meta = F.to_json(F.struct(F.col("target_uri").alias("uri"), F.col("http_headers").alias("headers"), F.col("source").alias("payload_digest"), "length", "title", "lang", "links", *kept))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/json").alias("content_type"), meta.alias("content")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain").alias("content_type"), F.col("text").alias("content")),
    )
    out = base.select("record_id", "target_uri", "date", "source", F.explode(kinds).alias("k"))
    return out.select(record_id(F.col("record_id"), F.col("k.warc_type")).alias("record_id"), "k.warc_type", "target_uri", "date", F.col("record_id").alias("refers_to"), F.col("source").alias("refers_to_digest"), digest(F.col("k.content")).alias("payload_digest"), "k.content_type", "k.content")


def responses_of(pages: DataFrame) -> DataFrame:
    """Response records of a table of pages (page_id, url, html), one a row.

    Null and empty pages are kept as they are; a null url gives a null address, and repeated rows give repeated records
    with the same id. Other columns are left out, an empty table gives no rows.
    """
    return pages.select("page_id", record_id(F.lit("response"), F.col("page_id").cast("string"), F.col("url")).alias("record_id"), F.col("url").alias("target_uri"), F.lit("1970-01-01T00:00:00Z").alias("date"), F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8").alias("http_headers"), F.col("html").alias("body"))


# --- files ----------------------------------------------------------------------------------------------


BLOCK = 1 << 20


def plain(stream) -> Iterator[bytes]:
    """The bytes of an archive, block by block; gzip members, one a record as a rule, are undone as they come."""
    first = stream.read(2)
    if first != b"\x1f\x8b":
        while first:
            yield first
            first = stream.read(BLOCK)
        return
    one, raw = zlib.decompressobj(31), first
    while raw:
        while raw:
            out = one.decompress(raw, BLOCK)
            if out:
                yield out
            raw = one.unconsumed_tail
            if one.eof:
                raw, one = one.unused_data.lstrip(b"\0"), zlib.decompressobj(31)
            elif not raw and not out:
                break
        raw = stream.read(BLOCK)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive; one record is held at a time.

    A last record that breaks off is left out; bytes between records are passed over.
    """
    blocks, held = plain(stream), bytearray()

    def more() -> bool:
        block = next(blocks, None)
        held.extend(block or b"")
        return block is not None

    while True:
        while (at := held.find(b"WARC/")) < 0:
            del held[: max(0, len(held) - 4)]
            if not more():
                return
        del held[:at]
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        headers = {}
        for line in bytes(held[:end]).split(b"\r\n")[1:]:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = headers.get("content-length", "")
        size = int(size) if size.isdigit() else 0
        while len(held) < end + 4 + size:
            if not more():
                return
        yield headers, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]


def unchunked(body: bytes) -> bytes:
    """A body without chunked transfer encoding; one that is not chunked as its header says is left as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.fullmatch(rb"\s*([0-9A-Fa-f]+)\s*(?:;.*)?", body[at:end], re.S) if end >= 0 else None
        if not size:
            return b"".join(out) if out and at >= len(body) else body
        n = int(size[1], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def body_text(head: str, body: bytes) -> str:
    """The text of a payload: transfer and content encoding undone, read in the charset of the header, the page or UTF-8.

    An encoding that is not known (br, zstd) or broken is left as it is.
    """
    fields: dict[str, str] = {}
    for line in head.split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = unchunked(body)
    for coding in reversed([c.strip() for c in fields.get("content-encoding", "").lower().split(",")]):
        for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
            try:
                body = zlib.decompressobj(bits).decompress(body)
                break
            except zlib.error:
                continue
    named = re.search(r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", fields.get("content-type", "")) or re.search(r"(?i)<meta[^>]*?charset\s*=\s*[\"']?([\w.:-]+)", body[:4096].decode("latin-1"))
    try:
        return body.decode(named[1] if named else "utf-8", "replace").encode("utf-8", "replace").decode()
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


RESPONSE = "record_id string, target_uri string, date string, http_headers string, body string, source_digest string, block_digest string, warc_headers map<string,string>, raw_body binary"


def read_responses(files: DataFrame) -> DataFrame:
    """Response records of WARC files, one row of files for each: the columns that derive() takes.

    A row has the file's address in path; the task that gets it reads the file as a stream, by pyarrow's file systems
    (local, hdfs, s3, gs), and holds one record at a time. A row may have the bytes in content instead, as binaryFile
    gives them. source_digest and block_digest are those of the record, null where it has none; warc_headers are all
    its headers (lower-case names), raw_body the bytes that the digests are of. Rows without either give nothing, as do
    empty files and records of other types; a record that breaks off is left out; repeated files give repeated
    records; other columns are not looked at.
    """
    source = "content" if "content" in files.columns else "path"

    def make():
        names = ["record_id", "target_uri", "date", "http_headers", "body", "source_digest", "block_digest", "warc_headers", "raw_body"]
        kinds = [*[pa.string()] * 7, pa.map_(pa.string(), pa.string()), pa.binary()]

        def opened(value):
            if source == "content":
                return io.BytesIO(value)
            system, path = fs.FileSystem.from_uri(value if "://" in value or value.startswith("file:") else "file://" + value)
            return system.open_input_stream(path, compression=None)

        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            for value in batch.column(0):
                if not value.is_valid:
                    continue
                rows, held = [], 0
                with opened(value.as_py()) as stream:
                    for h, block in parse(stream):
                        if h.get("warc-type") != "response":
                            continue
                        head, _, body = block.partition(b"\r\n\r\n")
                        text = head.decode("utf-8", "replace")
                        rows.append((h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), text, body_text(text, body), h.get("warc-payload-digest"), h.get("warc-block-digest"), list(h.items()), body))
                        held += len(body)
                        if held > 8 * BLOCK or len(rows) == 500:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

        return each

    return map_batches(files.select(source), make, RESPONSE)


def packed_records(records: DataFrame) -> DataFrame:
    """records with warc, the record as the bytes of a file: compressed on its own, so that files can be concatenated.

    A null date or address is written empty, a record without id, kind or content gets null bytes. Other columns are
    carried along, an own warc is replaced; repeated rows and empty tables need no care.
    """
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), "warc_type", F.lit("\r\nWARC-Record-ID: "), "record_id", F.lit("\r\nWARC-Date: "), F.coalesce("date", F.lit("")),
        F.lit("\r\nWARC-Target-URI: "), F.coalesce("target_uri", F.lit("")), F.lit("\r\nWARC-Refers-To: "), "refers_to", F.lit("\r\nWARC-Refers-To-Payload-Digest: "), "refers_to_digest",
        F.lit("\r\nWARC-Block-Digest: "), "payload_digest", F.lit("\r\nContent-Type: "), "content_type", F.lit("\r\nContent-Length: "), F.octet_length("content").cast("string"), F.lit("\r\n\r\n"), "content", F.lit("\r\n\r\n"),
    )

    @F.pandas_udf("binary")
    def squeeze(texts):
        def one(text):
            out = io.BytesIO()
            with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as f:
                f.write(text.encode())
            return out.getvalue()

        return texts.map(one, na_action="ignore")

    return records.withColumn("warc", squeeze(head))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derive(responses_of(table(spark, sf_dir, "pages")))
    size = F.octet_length("content").cast("long").alias("n_bytes")
    return found.select("record_id", "warc_type", "target_uri", "refers_to", "refers_to_digest", "payload_digest", size, F.when(F.col("warc_type") == "conversion", F.col("content")).alias("text"))


def _sql() -> str:
    text = lambda x: "regexp_replace(regexp_replace(regexp_replace(" + "replace(" * len(ENTITIES) + rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '<!--.*?-->', ' ', 'gis'), '<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'gis'), '\s+', ' ', 'g'), '</?(?:{BLOCKS})(?:\s[^>]*)?/?>', chr(10), 'gi'), '<[^>]*>', '', 'g')" + "".join(f", '{n}', '{s.replace(chr(39), chr(39) * 2)}')" for n, s in ENTITIES) + r", ' *\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g'), ' +', ' ', 'g')"
    uuid = lambda h: f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-a' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>'"
    return rf"""
WITH r AS (SELECT url, coalesce(html, '') AS body, {uuid("sha256(concat_ws('|', 'response', CAST(page_id AS VARCHAR), url))")} AS rid FROM pages),
p AS (SELECT *, 'sha256:' || sha256(body) AS source, {text("body")} AS text, {text("regexp_extract(body, '(?is)<title[^>]*>(.*?)</title', 1)")} AS title,
  regexp_extract(body, '(?i)<html[^>]*\slang=["'']?([A-Za-z-]+)', 1) AS lang, regexp_extract_all(body, '(?i)<a\s[^>]*?href=["'']([^"''>]*)', 1) AS links FROM r),
k AS (SELECT rid, url, source, 'conversion' AS kind, text AS content FROM p UNION ALL
  SELECT rid, url, source, 'metadata', CAST(to_json({{'uri': url, 'headers': 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8', 'payload_digest': source, 'length': strlen(body), 'title': title, 'lang': lang, 'links': links}}) AS VARCHAR) FROM p)
SELECT {uuid("sha256(rid || '|' || kind)")} AS record_id, kind AS warc_type, url AS target_uri, rid AS refers_to, source AS refers_to_digest,
  'sha256:' || sha256(content) AS payload_digest, CAST(strlen(content) AS BIGINT) AS n_bytes, CASE WHEN kind = 'conversion' THEN content END AS text FROM k
"""


OP9_SQL = _sql()
