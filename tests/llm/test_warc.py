import base64
import gzip
import hashlib

import pytest

from quern.llm import warc


def test_versions_of_arc_parse():
    content = b"HTTP/1.1 200 OK\r\nX-Archive-Key: 7\r\n\r\nbody\nwith lines\n\nURL like http://x 1 2 3 4"
    for version in (1, 2):
        data = warc.gzip_member(warc.arc_version_block("f", version, "20240102")) + warc.gzip_member(warc.arc_record("http://a b/ü", "20240102030405", content, version))
        ((header, got),) = warc.parse_arc(data)
        assert got == content and header["URL"] == "http://a%20b/%C3%BC" and list(header) == warc.FIELDS[version]
        # One member for the whole file is as good.
        assert [c for _, c in warc.parse_arc(gzip.compress(b"".join(warc.gunzip(data))))] == [content]
    assert warc.iso_date("20240102030405") == "2024-01-02T03:04:05Z" and warc.iso_date("2024") == "2024-01-01T00:00:00Z"


def test_broken_archives():
    with pytest.raises(warc.ArcError):
        list(warc.parse_arc(gzip.compress(b"http://x 0.0.0.0 2024 text/html 1\nx\n")))
    block = warc.arc_version_block("f", 1, "20240102")
    for bad in (b"http://x 0.0.0.0 2024 text/html 9\nx\n", b"http://x 0.0.0.0 text/html 1\nx\n"):
        with pytest.raises(warc.ArcError):
            list(warc.parse_arc(gzip.compress(block + bad)))
    with pytest.raises(warc.ArcError):
        list(warc.parse_arc(gzip.compress(block.replace(b"1 0 quern", b"3 0 quern"))))
    record = warc.warc_record({"WARC-Type": "response"}, b"abc")
    with pytest.raises(warc.WarcError):
        list(warc.parse_warc(gzip.compress(record[:-5] + b"\r\n\r\n")))


def test_plain_files_and_blanks_in_urls():
    block = warc.arc_version_block("f", 1, "20240102")
    data = block + b"http://x/a b c 0.0.0.0 2024 text/html 3\nabc\n\nhttp://y 0.0.0.0 2024 text/html 0\n\n"
    for form in (data, gzip.compress(data)):
        assert [(h["URL"], h["Archive-date"], c) for h, c in warc.parse_arc(form)] == [("http://x/a b c", "2024", b"abc"), ("http://y", "2024", b"")]


def test_bad_records_are_noted():
    good, block = warc.arc_record("http://x", "2024", b"abc", 1), warc.arc_version_block("f", 1, "2024")
    for bad, at in ((b"no header", 0), (b"http://x 0.0.0.0 2024 text/html 99\nx", 0), (b"http://x 0.0.0.0 2024 text/html -1\nx", 0), (good + b"a b\n", len(good))):
        members = [block, good, bad, good]
        errors = []
        found = list(warc.parse_arc(b"".join(map(warc.gzip_member, members)), errors))
        assert len(found) == 2 + (at > 0) and [e[:2] for e in errors] == [(2, at)]
        with pytest.raises(warc.ArcError):
            list(warc.parse_arc(b"".join(map(warc.gzip_member, members))))
    cut = warc.gzip_member(block) + warc.gzip_member(good) + warc.gzip_member(good)[:-9]
    errors = []
    assert len(list(warc.parse_arc(cut, errors))) == 1 and "cut off" in errors[0][2]
    errors = []
    assert list(warc.parse_arc(b"", errors)) == errors == []


def test_bad_records_in_a_table(spark):
    good, block = warc.gzip_member(warc.arc_record("http://x", "2024", b"abc", 1)), warc.gzip_member(warc.arc_version_block("f", 1, "2024"))
    arcs = spark.createDataFrame([("a.arc.gz", block + good + warc.gzip_member(b"bad\n") + good, 1), ("b.arc.gz", None, 2), ("c.arc.gz", bytearray(b"junk"), 3)], "file string, bytes binary, id long")
    assert [(r["file"], r["member"]) for r in warc.bad_records(arcs).orderBy("file").collect()] == [("a.arc.gz", 2), ("c.arc.gz", 0)]
    assert warc.read_warc(warc.convert(arcs, strict=False)).count() == 2


def test_members_are_found_in_linear_time():
    import time

    one = warc.gzip_member(b"x" * 3000 + bytes(range(256)) * 4)
    took = []
    for n in (1_000, 16_000):
        data, began = one * n, time.process_time()
        assert sum(1 for _ in warc.gunzip(data)) == n
        took.append(time.process_time() - began)
    assert took[1] < 60 * took[0] + 1


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("least", [0, 3])
def test_round_trip(spark, version, least, monkeypatch, tmp_path):
    pages = [(1, "http://a", "same"), (5, None, "same"), (3, "http://c", "same"), (4, "", ""), (9, "x y", None), (6, "u", "ünïcode \r\n\r\n HTTP/1.1"), (None, "n", "same"), (7, "l", "z" * 300_000), (8, "t", "ab"), (2, "t", "ab")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, payload_digest string").repartition(3)
    archives = warc.convert(warc.write_arc(df, version), least)
    got = warc.read_warc(archives).collect()
    assert len(got) == len(pages)
    for key, _, html in pages:
        body = (html or "").encode()
        equal = [k for k, _, h in pages if (h or "") == (html or "") and k is not None]
        (r,) = [r for r in got if r["key"] == (None if key is None else str(key))]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = max(equal)
        revisit = len(body) >= least and key != first
        assert (r["record_type"], r["refers_to"]) == (("revisit", str(first)) if revisit else ("response", None))
    paths = warc.export_files(archives, str(tmp_path))
    assert paths and all(gzip.open(p).read(8) == b"WARC/1.0" for p in paths)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.convert(warc.write_arc(df))).count() == 0
