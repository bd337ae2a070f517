"""Archives: what is written, read back alone by offset, and read back as a whole."""

import base64
import gzip
import hashlib
import zlib
from pathlib import Path

import pytest

from flightlens.llm import warc

PAGES = [
    (1, "http://a.example/", "<p>same</p>"),
    (2, "http://b.example/x y\r\n", "<p>same</p>"),
    (9, "http://c.example/", "<p>same</p>"),
    (9, "http://c.example/", "<p>same</p>"),
    (None, None, "<p>same</p>"),
    (3, None, None),
    (4, "u", ""),
    (5, "u", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n𝄞"),
    (6, "u", "x" * 3_000_000),
    (7, "u", "alone"),
]


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


@pytest.fixture(scope="module")
def archived(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "out")
    df = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, digest string")
    return path, warc.archive(df, path, per_file=4).collect()


def test_records(archived):
    _, index = archived
    want = []
    for page, _, html in PAGES:
        ids = [p if p is not None else float("-inf") for p, _, h in PAGES if (h or "") == (html or "")]
        top = int(max(ids))
        kind, refers = ("response", None) if page == top else ("revisit", top)
        want.append((page, len((html or "").encode()), sha(html or ""), kind, refers))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(r.intact for r in index)


def test_each_record_is_a_member_of_its_own(archived):
    _, index = archived
    for r in index:
        data = Path(r.file.removeprefix("file:")).read_bytes()
        one = zlib.decompressobj(31)
        record = one.decompress(data[r.offset : r.offset + r.length])
        assert one.eof and not one.unused_data and record.startswith(b"WARC/1.1\r\n")
        assert f"<urn:page:{'none' if r.page_id is None else r.page_id}>".encode() in record


def test_whole_files_are_valid_gzip_before_and_after(archived):
    path, _ = archived
    before = sorted(gzip.decompress(p.read_bytes()) for p in Path(path, "monolithic").glob("*.gz"))
    after = sorted(gzip.decompress(p.read_bytes()) for p in Path(path, "records").glob("*/part-*"))
    assert before == after and len(before) > 1
    for p in Path(path, "monolithic").glob("*.gz"):
        one = zlib.decompressobj(31)
        one.decompress(p.read_bytes())
        assert one.eof and not one.unused_data  # a single stream


def test_broken_streams_are_reported():
    whole = gzip.compress(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n" * 3)
    assert len(list(warc.cut(warc.inflated(whole)))) == 3
    with pytest.raises(ValueError):
        list(warc.cut(warc.inflated(whole[:-12])))
    with pytest.raises(ValueError):
        list(warc.cut([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab\r\n\r\n"]))
    with pytest.raises(ValueError):
        list(warc.cut([b"junk\r\n\r\n"]))


def test_empty_table(spark, rows):
    assert warc.archive(rows("page_id long, url string, html string")).collect() == []
