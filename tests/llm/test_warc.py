import io
import gzip
import hashlib
import json

from tidewatch.llm import warc

PAGE = "<!DOCTYPE html><html lang='fr'><head><title>A &amp; B</title><script>x<p>y</script><style>p{}</style></head><body><!-- no --><p>One  <b>two</b></p>three<br/>four&nbsp;<a href=\"/x\">five</a></body></html>"


def test_records_refer_to_their_response(spark):
    rows = [("<urn:uuid:1>", "http://a", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK", PAGE), ("<urn:uuid:2>", None, None, None, None), (None, "http://b", None, None, "x"), ("<urn:uuid:1>", "http://a", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK", PAGE), ("<urn:uuid:3>", "u", "", "", "word " * 50_000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "record_id string, target_uri string, date string, http_headers string, body string, content int")
    got = warc.derive(frame).collect()
    assert len(got) == 8
    first = {r.warc_type: r for r in got if r.refers_to == "<urn:uuid:1>"}
    assert first["conversion"].content == "A & B\nOne two\nthree\nfour five"
    assert json.loads(first["metadata"].content) == {"uri": "http://a", "headers": "HTTP/1.1 200 OK", "payload_digest": first["metadata"].refers_to_digest, "length": len(PAGE), "title": "A & B", "lang": "fr", "links": ["/x"]}
    assert {r.content for r in got if r.refers_to == "<urn:uuid:2>" and r.warc_type == "conversion"} == {""}
    assert len({r.record_id for r in got}) == 6
    assert warc.derive(frame.limit(0)).count() == 0


def test_files_round_trip(spark):
    block = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n<p>hi \xc3\xa9</p>"
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:9>\r\nWARC-Target-URI: http://c\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: %d\r\n\r\n" % len(block)
    raw = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nab\r\n\r\n" + head + block + b"\r\n\r\n"
    files = spark.createDataFrame([("a", bytearray(raw)), ("b", None), ("c", bytearray(b"")), ("d", bytearray(b"junk"))], "path string, content binary")
    responses = warc.read_responses(files)
    assert [r.body for r in responses.collect()] == ["<p>hi é</p>"]
    records = warc.packed_records(warc.derive(responses)).collect()
    parsed = list(warc.parse(io.BytesIO(b"".join(bytes(r.warc) for r in records))))
    assert len(parsed) == 2
    for (h, body), r in zip(parsed, records):
        assert h["warc-refers-to"] == "<urn:uuid:9>" and h["warc-type"] == r.warc_type and body.decode() == r.content
        assert h["warc-block-digest"] == r.payload_digest


def test_source_digests_and_encodings(spark):
    packed = gzip.compress("<p>caf\u00e9</p>".encode("latin-1"))
    chunked = b"%x\r\n%b\r\n%x;x=1\r\n%b\r\n0\r\n\r\n" % (5, packed[:5], len(packed) - 5, packed[5:])
    coded = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunked
    plain = b"HTTP/1.1 200 OK\r\n\r\n<meta charset=latin1><p>\xe9</p>"
    raw = b""
    for name, extra, block in (("1", b"WARC-Payload-Digest: sha1:ABC\r\nWARC-Block-Digest: sha1:DEF\r\nWARC-IP-Address: 192.0.2.1\r\n", coded), ("2", b"", plain)):
        raw += b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:%b>\r\n%bContent-Length: %d\r\n\r\n%b\r\n\r\n" % (name.encode(), extra, len(block), block)
    responses = warc.read_responses(spark.createDataFrame([("a", bytearray(raw))], "path string, content binary"))
    one, two = responses.orderBy("record_id").collect()
    assert (one.body, one.source_digest, one.block_digest, one.warc_headers["warc-ip-address"], bytes(one.raw_body)) == ("<p>caf\u00e9</p>", "sha1:ABC", "sha1:DEF", "192.0.2.1", chunked)
    assert two.source_digest is None and two.body.endswith("<p>\u00e9</p>")
    got = {(r.refers_to, r.warc_type): r for r in warc.derive(responses).collect()}
    assert {r.refers_to_digest for k, r in got.items() if "1" in k[0]} == {"sha1:ABC"}
    assert {r.refers_to_digest for k, r in got.items() if "2" in k[0]} == {"sha256:" + hashlib.sha256(plain.partition(b"\r\n\r\n")[2]).hexdigest()}
    assert got["<urn:uuid:1>", "conversion"].content == "caf\u00e9"
    meta = json.loads(got["<urn:uuid:1>", "metadata"].content)
    assert (meta["length"], meta["block_digest"], meta["warc_headers"]["warc-ip-address"]) == (len(chunked), "sha1:DEF", "192.0.2.1")


def test_files_are_read_as_streams(spark, tmp_path, monkeypatch):
    """By path as by content, whatever the size of the blocks; records that break off are left out."""
    record = lambda i, kind, body: b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <r%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, i, len(body), body)
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>" + b"x" * 3000
    records = [record(0, b"warcinfo", b"a"), record(1, b"response", page), record(2, b"request", b"b"), record(3, b"response", page + b"WARC/1.1"), record(4, b"response", page)]
    whole = {"plain.warc": b"".join(records), "each.warc.gz": b"".join(map(gzip.compress, records)), "one.warc.gz": gzip.compress(b"".join(records)), "empty.warc": b"", "torn.warc": b"".join(records)[:-900], "torn.warc.gz": b"".join(map(gzip.compress, records))[:-40]}
    for name, raw in whole.items():
        (tmp_path / name).write_bytes(raw)
        want = [1, 3] if "torn" in name else [] if "empty" in name else [1, 3, 4]
        for block in (1 << 20, 7):
            monkeypatch.setattr(warc, "BLOCK", block)
            assert [h["warc-record-id"] for h, _ in warc.parse(io.BytesIO(raw)) if h["warc-type"] == "response"] == [f"<r{i}>" for i in want]
        got = warc.read_responses(spark.createDataFrame([(f"file://{tmp_path}/{name}", 1)], "path string, body int")).collect()
        assert sorted(r.record_id for r in got) == [f"<r{i}>" for i in want]
        assert all(bytes(r.raw_body).startswith(b"<p>xxx") for r in got)
    assert warc.read_responses(spark.createDataFrame([(None,)], "path string")).count() == 0
