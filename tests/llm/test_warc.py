"""Archives: round trips, revisits, and records that are wrong."""

import hashlib
import io

import pytest
import zstandard

from pipekit.llm import warc
from pipekit.session import fresh_path

SCHEMA = "page_id long, html string, url string, key string, same string, first long, payload string, file string"


def pages():
    big, other = "ä<p>" * 400, "x" * 1000
    rows = [(1, big), (2, "short"), (3, "short"), (4, None), (5, other), (6, big), (7, big), (7, big), (8, ""), (None, big)]
    rows += [(None, "y" * 2000), (9, "z" * 999), (10, "z" * 999), (11, other), (12, "long " * 200_000)]
    return [(i, t, None if i == 2 else f"http://h/{i}?q=a b\r\n", "k", "s", 0, "p", "f") for i, t in rows]


def test_round_trip(spark):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(3)
    written = warc.write_archives(df, fresh_path(spark, "warc"), "page_id", "html", "url")
    found = warc.read_archives(written).collect()
    assert sum(r.n_records for r in written.collect()) == len(found) == len(pages())
    want = []
    for i, text, url, *_ in pages():
        data = (text or "").encode()
        equal = [j for j, t, *_ in pages() if t == text and j is not None]
        last = str(max(equal)) if len(data) >= 1000 and equal and i != max(equal) else None
        key, payload = None if i is None else str(i), data if last is None else None
        want.append((key, url, "revisit" if last else "response", last, payload, len(data), hashlib.sha1(data).hexdigest(), None))
    order = lambda rows: sorted(rows, key=lambda r: tuple(map(str, r)))
    assert order((*r[:4], None if r[4] is None else bytes(r[4]), *r[5:]) for r in found) == order(want)
    assert "payload" not in warc.read_archives(written, payloads=False).columns


def test_paths_without_a_scheme(spark, tmp_path):
    """They belong to Spark's default file system."""
    df = spark.createDataFrame(pages()[:3], SCHEMA)
    written = warc.write_archives(df, str(tmp_path / "a b"), "page_id", "html", "url")
    assert all(r.file.startswith("file:///") for r in written.collect())
    assert warc.read_archives(written).where("problem IS NULL").count() == 3


def test_no_pages(spark):
    df = spark.createDataFrame([], SCHEMA)
    written = warc.write_archives(df, fresh_path(spark, "warc"), "page_id", "html", "url")
    assert written.count() == warc.read_archives(written).count() == 0


def archive(records):
    out = io.BytesIO()
    close, out.close = out.close, lambda: None
    writer = warc.ArchiveWriter(out)
    for record in records:
        writer.add(record)
    writer.close()
    data = out.getvalue()
    close()
    return data


def test_dictionary_frame():
    records = [warc.build_record(str(i), "http://h/", f"<html>page {i} of many</html>".encode() * 20, None) for i in range(400)]
    data = archive(records)
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY
    assert [c for c, _ in warc.frames(io.BytesIO(data))] == records
    size = 8 + int.from_bytes(data[4:8], "little")
    with pytest.raises(zstandard.ZstdError):  # the records need the dictionary
        zstandard.ZstdDecompressor().decompress(data[size:])
    packed = zstandard.ZstdCompressor().compress(data[8:size])
    repacked = data[:4] + len(packed).to_bytes(4, "little") + packed + data[size:]
    assert [c for c, _ in warc.frames(io.BytesIO(repacked))] == records
    assert [c for c, _ in warc.frames(io.BytesIO(archive(records[:2])))] == records[:2]


@pytest.mark.parametrize("at", [2, 6, 5000, -3])
def test_cut_archives(at):
    records = [warc.build_record(str(i), None, f"page {i} of many".encode() * 99, None) for i in range(300)]
    found = list(warc.frames(io.BytesIO(archive(records)[:at])))
    assert found[-1][0] is None and found[-1][1]
    assert [c for c, _ in found[:-1]] == records[: len(found) - 1]


@pytest.mark.parametrize(
    ("old", "new", "problem"),
    [
        (b"WARC/1.1", b"HTTP/1.1", "no WARC header"),
        (b"WARC-Date", b"WARC-Data", "no warc-date"),
        (b"Content-Length: 91", b"Content-Length: 92", "a length that does not fit"),
        (b"Content-Length: 12", b"Content-Length: 13", "a payload of another length"),
        (b"hello", b"hellO", "a payload of another digest"),
        (b"sha1:", b"md5: ", "no SHA-1"),
        (b"WARC-Type: response", b"WARC-Type: revisit ", "a revisit with a payload"),
        (b"WARC-Date: ", b"WARC-Date; ", "no warc-date|a header line"),
    ],
)
def test_broken_records(old, new, problem):
    import re

    record = warc.build_record("1", None, b"hello, world", None)
    assert warc.parse_record(record)["problem"] is None and old in record
    assert re.search(problem, warc.parse_record(record.replace(old, new, 1))["problem"])
