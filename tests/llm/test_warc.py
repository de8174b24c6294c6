import gzip
import hashlib
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import warc
from lumenframe.llm.common import shared_folder


def archive(n=200, payload=None):
    members = [warc.encode_record(str(i), f"http://h/{i}\r\n%", payload or os.urandom(3) * (i * 7 % 90), "0" * 64, "3" if i % 5 == 4 else None) for i in range(n)]
    return members, b"".join(members)


@pytest.mark.parametrize("split", [1, 7, 100, 333, 10**6])
def test_every_record_belongs_to_one_range(split):
    members, raw = archive(40 if split == 1 else 200)
    got = []
    for a in range(0, len(raw), split):
        got += [(o, n) for o, n, _ in warc.read_range(io.BytesIO(raw), a, min(a + split, len(raw)))]
    at, want = 0, []
    for m in members:
        want.append((at, len(m)))
        at += len(m)
    assert got == want


def test_false_magic_is_no_record():
    # gzip members that are no WARC records, between and inside records
    members, _ = archive(5, payload=b"\x1f\x8b\x08" * 50 + os.urandom(500))
    raw = b"\x1f\x8b\x08junk".join([members[0], members[1], gzip.compress(b"not a record"), members[2]])
    assert [r for _, _, r in warc.read_range(io.BytesIO(raw), 0, len(raw))] == [gzip.decompress(m) for m in members[:3]]
    with pytest.raises(EOFError):
        list(warc.read_range(io.BytesIO(members[0][:-5]), 0, len(members[0])))


def test_round_trip_with_nulls_ties_and_hot_payloads(spark):
    big, small = "<p>é" * 100, "short"
    rows = [(i, f"http://x/{i}", big) for i in range(30, 10, -1)] + [(5, None, small), (6, "a\nb%0A\r", small), (None, "n", big), (7, "z", None), (8, "z", ""), (11, "again", big), (99, "long", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("id", F.lit(0)).repartition(5)
    folder = shared_folder(spark, "warc")
    archives = warc.write_archives(warc.mark_revisits(pages), folder)
    records = warc.read_archives(archives, split=4096).collect()
    assert len(records) == len(rows) == sum(r.records for r in archives.collect())
    by = sorted((str(r.record_id), r.target_uri, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in records if r.record_id != "11")
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    revisit = lambda i, t: len((t or "").encode()) >= 100 and t == big and i != 11
    want = sorted((str(i), u, "revisit" if revisit(i, t) else "response", "11" if revisit(i, t) else None, len((t or "").encode()), sha(t)) for i, u, t in rows if i != 11)
    assert by == want
    twins = sorted(r.record_type for r in records if r.record_id == "11")
    assert twins == ["response", "revisit"]
    stored = {r.record_id: bytes(r.payload) for r in records if r.record_type == "response"}
    assert stored["11"] == big.encode() and len(stored["99"]) == 3_000_000 and stored["7"] == b""
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_plain_gzip(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, "v", "x" * 200)], "page_id long, url string, html string")
    path = warc.write_archives(warc.mark_revisits(pages), shared_folder(spark, "warc")).first().path
    fs, at = warc.file_system(path)
    with fs.open_input_file(at) as f:
        text = gzip.decompress(f.read())
    assert text.count(b"WARC/1.1\r\n") in (1, 2) and b"Content-Length: 200" in text


def nested(n=40, size=40_000):
    """Three records, of which the second holds an archive of incompressible records."""
    rnd = random.Random(4)
    inner = b"".join(warc.encode_record(f"in{i}", None, rnd.randbytes(size // 40 + i), "0" * 64, None) for i in range(n))
    outer = [warc.encode_record("1", "u", rnd.randbytes(70_000), "0" * 64, None), warc.encode_record("2", "v", inner * 8, "0" * 64, None), warc.encode_record("3", "w", b"end" * 100, "0" * 64, None)]
    return outer, b"".join(outer)


@pytest.mark.parametrize("split", [64, 4096, 1 << 16, 1 << 18, 1 << 22])
def test_a_stored_archive_inside_a_payload_is_no_archive(spark, tmp_path, split):
    outer, raw = nested()
    path = tmp_path / "nested.warc.gz"
    path.write_bytes(raw)
    file = io.BytesIO(raw)
    if split >= 4096:
        archives = spark.createDataFrame([(str(path), len(raw), 3)], warc.ARCHIVES)
        got = warc.read_archives(archives, split).orderBy("offset").collect()
        assert [(r.record_id, r.payload_bytes) for r in got] == [("1", 70_000), ("2", got[1].payload_bytes), ("3", 300)] and got[1].payload_bytes > 300_000
        assert [r.offset for r in got] == [0, len(outer[0]), len(outer[0]) + len(outer[1])]
    else:
        # the ranges' order alone, with walks that always find something
        spans = [(a, min(a + split, len(raw)), a, min(a + split, len(raw))) for a in range(0, len(raw), split)]
        spans[0] = (0, split, 0, len(outer[0]))
        owned = warc.settled(spans, lambda start, end: (start, len(outer[0]) + len(outer[1])) if start < len(outer[0]) + len(outer[1]) else (start, len(raw)))
        assert [c for _, _, c in owned] == [0, len(outer[0]), len(outer[0]) + len(outer[1])]
    assert [o for o, _, _ in warc.read_range(file, 0, len(raw))] == [0, len(outer[0]), len(outer[0]) + len(outer[1])]
    # a range that begins inside meets the inner records, or parts of them, and doesn't fail
    assert sum(1 for _ in warc.read_range(file, len(outer[0]) + 50_000, len(raw))) >= 1


def test_members_of_wrong_length_are_no_records():
    member = warc.encode_record("1", "u", b"x" * 50, "0" * 64, None)
    text = gzip.decompress(member)
    assert warc.whole_record(text)
    for wrong in (text[:-20], text.replace(b"Content-Length", b"Content-Size", 1), text + b"x", b"WARC/1.1", text.replace(b"Content-Length: ", b"Content-Length: -", 1)):
        assert not warc.whole_record(wrong)
        assert list(warc.read_range(io.BytesIO(gzip.compress(wrong) + member), 0, 10**6))[-1][2] == text


def test_equal_rows_with_null_ids_are_dealt_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK_ROWS", 7)
    big = "z" * 200
    rows = [(None, u, big) for u in ["b", "a", "a", None] for _ in range(10)] + [(4, "c", "y" * 300)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    marked = warc.mark_revisits(pages).collect()
    assert len(marked) == len(rows) and all(r.payload for r in marked)
    kept = sorted((r.url, r.id) for r in marked if r.refers_to is None)
    assert kept == [("a", None), ("c", 4)]
    assert {r.refers_to for r in marked if r.id is None and r.refers_to is not None} == {""}
    assert {r.refers_to for r in marked if r.id == 4} == {None, "4"}


def test_archives_have_a_bound(spark):
    pages = spark.createDataFrame([(i, "u", f"{i} " * 500) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(warc.mark_revisits(pages).coalesce(1), shared_folder(spark, "warc"), archive_bytes=2000)
    rows = archives.collect()
    assert len(rows) > 5 and sum(r.records for r in rows) == 60
    assert sorted(int(r.record_id) for r in warc.read_archives(archives, 512).collect()) == list(range(60))


def test_names_of_stores():
    assert warc._SCHEMES["s3a"] == "s3"
    assert warc.file_system("/tmp/x")[1] == "/tmp/x" and warc.file_system("file:/tmp/x")[1] == "/tmp/x"
