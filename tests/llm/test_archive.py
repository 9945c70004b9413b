import base64
import gzip
import hashlib
import re

from graphloom.llm import archive


def parse_warc(raw):
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    assert lines[0] == "WARC/1.0" and rest[size:] == b"\r\n\r\n"
    return fields, rest[:size]


def records():
    return [("http://a.example/x", "10.0.0.1", "20240131010203", "text/html", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>http://b.example/ 1.2.3.4 20240101 text/html 5\n</p>"), ("http://a.example/empty", "-", "20240131", "text/plain", b""), ("dns:a.example", "10.0.0.2", "20240131010203", "text/dns", b"\n\nraw\n")]


def test_both_versions_round_trip():
    for version in (1, 2):
        got = [archive.to_warc(*x) for x in archive.parse_arc(archive.write_arc(records(), version, "f.arc"))]
        assert [g["warc_type"] for g in got] == ["warcinfo", "response", "resource", "resource"]
        for g, (url, ip, date, kind, body) in zip(got[1:], records()):
            fields, block = parse_warc(g["record"])
            assert block == body and fields["WARC-Target-URI"] == url and fields["WARC-Date"] == archive.iso_date(date)
            assert fields.get("WARC-IP-Address") == (None if ip == "-" else ip)
            assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
            payload = body.split(b"\r\n\r\n", 1)[1] if body.startswith(b"HTTP/") else body
            assert fields["WARC-Payload-Digest"] == archive.digest(payload)
            assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"])
        assert len({g["warc_record_id"] for g in got}) == 4
        assert got == [archive.to_warc(*x) for x in archive.parse_arc(archive.write_arc(records(), version, "f.arc"))]


def test_damage_is_contained():
    arc = archive.write_arc(records(), 1, "f.arc")
    at = arc.index(b"http://a.example/empty")
    broken = arc[:at] + b"http://broken line\nbody\n" + arc[at:]
    got = [h.get("url", "error") for h, _ in archive.parse_arc(broken)]
    assert got == ["filedesc://f.arc", "http://a.example/x", "error", "http://a.example/empty", "dns:a.example"]
    cut = [h.get("url", "error") for h, _ in archive.parse_arc(arc[:-4])]
    assert cut[-1] == "error" and archive.to_warc({"error": "header"}, b"x")["warc_type"] == "metadata"
    assert list(archive.parse_arc(b"")) == [] and [h for h, _ in archive.parse_arc(b"junk")] == [{"error": "header"}]


def test_tables(spark):
    a = spark.createDataFrame([(1, bytearray(archive.write_arc(records(), 2, "g.arc"))), (None, None), (2, bytearray(b"")), (1, bytearray(archive.write_arc(records(), 2, "g.arc")))], "archive_id long, arc binary").selectExpr("*", "1 AS position", "2 AS record", "3 AS problem")
    got = archive.convert(a)
    assert got.count() == 8 and len({r["warc_record_id"] for r in got.collect()}) == 4
    assert archive.convert(a.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, "http://x/ y", "<p>é</p>"), (2, None, None), (None, "u:", ""), (3, "http://z/", "q" * 300_000)], "page_id long, url string, html string")
    out = archive.convert(archive.pages_as_arc(pages)).where("warc_type = 'response'").collect()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    assert {(r["archive_id"], r["target_uri"], r["content_length"] - len(head)) for r in out} == {(1, "http://x/%20y", 9), (2, "urn:none", 0), (None, "u:", 0), (3, "http://z/", 300_000)}
    assert any(r["record"].endswith("<p>é</p>".encode() + b"\r\n\r\n") for r in out)


#: Hand-written, as old crawlers wrote them: parameters in the content type, a space in a URL, IPv6, no type, dates that are none.
OLD = (
    b"filedesc://IA-2001.arc.gz 0.0.0.0 20010203040506 text/plain 76\n1 0 InternetArchive\nURL IP-address Archive-date Content-type Archive-length\n\n",
    b"http://a.example/one two 10.1.2.3 20010203040507 text/html; charset=utf-8 33\nHTTP/1.0 200 OK\nX: y\n\n<p>hello\n",
    b"http://a.example/none 2001:db8::1 200102030405 - 4\nbody\n",
    b"http://a.example/odd - 20011399 image/gif 3\nGIF\n",
)


def check_old(got):
    assert [g["warc_type"] for g in got] == ["warcinfo", "response", "resource", "resource"]
    assert [g["warc_date"] for g in got] == ["2001-02-03T04:05:06Z", "2001-02-03T04:05:07Z", "2001-02-03T04:05:00Z", "2001-02-03T04:05:00Z"]
    assert [g["content_type"] for g in got] == ["text/plain", "application/http; msgtype=response", "application/octet-stream", "image/gif"]
    assert [g["ip_address"] for g in got] == [None, "10.1.2.3", "2001:db8::1", None] and [g["problem"] for g in got] == [None, None, None, "date"]
    assert got[1]["target_uri"] == "http://a.example/one%20two" and got[1]["payload_digest"] == archive.digest(b"<p>hello")
    for g in got:
        fields, block = parse_warc(g["record"])
        assert fields["WARC-Date"] == g["warc_date"] and len(block) == g["content_length"] and fields["WARC-Type"] in ("warcinfo", "response", "resource", "metadata")


def old():
    """OLD with the lengths that its lines declare put right."""
    out = []
    for x in OLD:
        line, _, body = x.partition(b"\n")
        out.append(re.sub(rb"\d+$", str(len(body) - 1).encode(), line) + b"\n" + body)
    return out


def test_old_archives_plain_and_compressed():
    parts = old()
    check_old(list(archive.records(b"".join(parts))))
    check_old(list(archive.records(b"".join(map(gzip.compress, parts)))))
    check_old(list(archive.records(gzip.compress(b"".join(parts)))))
    resource = list(archive.records(b"http://a/ 1.1.1.1 20010203 text/html; charset=utf-8 1\nx\n"))
    assert [r["content_type"] for r in resource] == ["text/html; charset=utf-8"]


def test_a_bad_gzip_member_is_contained():
    members = list(map(gzip.compress, old()))
    bad = members[1][:20] + b"\0" * (len(members[1]) - 20)
    got = list(archive.records(members[0] + bad + members[2] + members[3][:-5]))
    assert [g["problem"] for g in got] == [None, "gzip", None, "gzip"] and got[1]["record"].endswith(bad + b"\r\n\r\n")
    assert [g["warc_date"] for g in got] == ["2001-02-03T04:05:06Z", "2001-02-03T04:05:06Z", "2001-02-03T04:05:00Z", "2001-02-03T04:05:00Z"]


def test_files(spark, tmp_path):
    (tmp_path / "a.arc").write_bytes(b"".join(old()))
    (tmp_path / "b.arc.gz").write_bytes(b"".join(map(gzip.compress, old())))
    got = archive.convert(archive.read_archives(spark, str(tmp_path))).collect()
    for name in ("a.arc", "b.arc.gz"):
        check_old(sorted((r.asDict() for r in got if r["archive_id"].endswith(name)), key=lambda r: r["position"]))


def test_ids_that_are_no_numbers(spark):
    pages = spark.createDataFrame([("x-1", "http://x/", "a"), (None, "u:", "b")], "page_id string, url string, html string")
    assert {(r["archive_id"], r["problem"]) for r in archive.convert(archive.pages_as_arc(pages)).collect()} == {("x-1", None), (None, None)}
