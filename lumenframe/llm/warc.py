"""WARC archives: a writer with revisit records and a splittable reader.

Each record is a gzip member of its own.  The reader deals byte ranges of the
archives to tasks.  A task looks for the gzip magic from its range's start,
takes a place as a member only if it decodes to a WARC header whose length
fits the member, and owns the records that start inside the range, reading
past its end to finish the last.

A payload may itself hold an archive, stored as it is, whose members a range
that starts among them can't tell from real ones.  So ranges are read twice:
first each says where its records begin and where the first one behind it
does; only the file's beginning is known for certain, and a range's guess
holds if the range before it ends there.  What doesn't fit is looked at again
from the place that is known.  So every record is read exactly once, however
ranges are cut.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import checkpointed, shared_folder

MAGIC = b"\x1f\x8b\x08"
#: Shorter payloads are always stored.
MIN_REVISIT = 100
SPLIT = 16 << 20
#: A task begins another archive when one has so many bytes.
ARCHIVE_BYTES = 1 << 30
_CHUNK = 1 << 20
CHUNK_ROWS = 10_000

ARCHIVES = T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("records", T.LongType())])
RECORDS = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload", T.BinaryType()),
])


#: Names that Spark's file systems and Arrow's have for one store.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "viewfs": "viewfs"}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Where a shared path lives: a local path or any URI that Arrow opens, by Spark's names of stores too."""
    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    scheme, colon, rest = path.partition(":")
    return pafs.FileSystem.from_uri(_SCHEMES.get(scheme, scheme) + colon + rest)


def _line(value: str) -> str:
    """Header values are one line; what would break it is percent-encoded."""
    return "".join(c if c not in "\r\n\x00%" else f"%{ord(c):02X}" for c in value)


def _unline(value: str) -> str:
    for code, c in (("%0D", "\r"), ("%0A", "\n"), ("%00", "\x00"), ("%25", "%")):
        value = value.replace(code, c)
    return value


def encode_record(record_id: str | None, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One gzip member: a response, or a revisit if ``refers_to`` names one.

    A revisit keeps the HTTP header, with the payload's length, but no body.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if record_id is not None:
        fields.append(f"WARC-Record-ID: <urn:x-page:{record_id}>")
    if uri is not None:
        fields.append(f"WARC-Target-URI: {_line(uri)}")
    if refers_to is not None:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    raw = "\r\n".join(fields).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def mark_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """``id``, ``url``, ``payload``, ``digest`` and ``refers_to`` (null: store it).

    Payloads are UTF-8 bytes of any length, null is empty.  Of equal payloads
    of at least ``MIN_REVISIT`` bytes, the row with the smallest id is stored
    (null ids come last; of rows that share that id, one with the smallest
    url) and the others refer to it.  Every row gives a record, repeated ones
    too; an empty table gives none; other columns of ``pages`` go.
    The lookup by digest combines on the map side; the join has plain
    exchanges on both sides, so a hot digest is split.  Rows are told apart by
    their values only, so a task that runs again decides alike.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), payload).withColumn("digest", F.sha2("payload", 256))
    counted = rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest", "id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("n").alias("twins")))
    found = counted.groupBy("digest").agg(first.alias("first"), F.sum("n").alias("n")).where("n > 1")
    found = checkpointed(found.select(F.reverse("digest").alias("key"), "first.none", F.col("first.id").alias("first_id"), "first.twins"))
    joined = rows.withColumn("key", F.reverse("digest")).join(found, "key", "left")
    lead = F.col("first_id").eqNullSafe(F.col("id")) & F.col("twins").isNotNull()
    name = F.coalesce(F.col("first_id").cast("string"), F.lit(""))
    refers = F.when(F.col("twins").isNotNull() & ~lead, name)
    out = ["id", "url", "payload", "digest"]
    if found.where("twins > 1").isEmpty():
        return joined.select(*out, refers.alias("refers_to"))
    # Rows that repeat a group's smallest id: one with the smallest url is
    # stored.  Equal rows are counted first and dealt out again in chunks, so
    # that no task holds them all.
    several = lead & (F.col("twins") > 1)
    equal = joined.where(several).groupBy("digest", "id", "url").agg(F.first("payload").alias("payload"), F.count("*").alias("n__"))
    equal = checkpointed(equal)
    order = F.struct(F.col("url").isNull(), "url")
    least = equal.groupBy("digest", "id").agg(F.min(order).alias("least__")).select(F.col("digest").alias("d__"), F.col("id").alias("i__"), "least__")
    ranked = equal.join(least, (F.col("digest") == F.col("d__")) & F.col("id").eqNullSafe(F.col("i__")))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n__") - 1) / CHUNK_ROWS))).alias("chunk__")
    chunks = ranked.select(*[c for c in out], "n__", (order == F.col("least__")).alias("own__"), chunk)
    if not equal.where(F.col("n__") > CHUNK_ROWS).isEmpty():
        chunks = chunks.repartition("chunk__", "digest", "url")
    row = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n__") - F.col("chunk__") * CHUNK_ROWS, F.lit(CHUNK_ROWS)))).alias("row__")
    stored = F.col("own__") & (F.col("chunk__") == 0) & (F.col("row__") == 1)
    twins = chunks.select(*out, "own__", "chunk__", row).select(*out, F.when(~stored, F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("refers_to"))
    return joined.where(~F.coalesce(several, F.lit(False))).select(*out, refers.alias("refers_to")).union(twins)


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``mark_revisits`` rows as archives, one for each task or more of about ``archive_bytes``; returns ``ARCHIVES``.

    A task writes under a name of its own and reports it at its end, so what
    a lost or doubled attempt leaves is never read.  The write runs now; the
    small manifest is kept in the shared folder.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        done: list[tuple[str, int, int]] = []
        name, at, n, out = "", 0, 0, None
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if out is not None and at >= archive_bytes:
                        out.close()
                        done.append((name, at, n))
                        out = None
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        name, at, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(file_system(name)[1], compression=None)
                    member = encode_record(None if row["id"] is None else str(row["id"]), row["url"], row["payload"], row["digest"], row["refers_to"])
                    out.write(member)
                    at, n = at + len(member), n + 1
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append((name, at, n))
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "bytes", "records"), zip(*done))), schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    spark = records.sparkSession
    manifest = f"{folder}/manifest"
    records.mapInArrow(write, ARCHIVES).write.parquet(manifest)
    return spark.read.schema(ARCHIVES).parquet(manifest)


def parse_record(raw: bytes) -> dict:
    """The fields of ``RECORDS`` that one decoded member holds."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields.get("Content-Length", len(rest)))]
    http, _, body = block.partition(b"\r\n\r\n")
    kind = fields.get("WARC-Type")
    length = dict(line.split(": ", 1) for line in http.decode("latin-1").split("\r\n")[1:] if ": " in line).get("Content-Length")
    own = lambda name: fields[name].removeprefix("<urn:x-page:").removesuffix(">") if name in fields else None
    digest = hashlib.sha256(body).hexdigest() if kind == "response" else fields.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None
    return {
        "record_type": kind, "record_id": own("WARC-Record-ID"), "refers_to": own("WARC-Refers-To"),
        "target_uri": _unline(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None, "payload_digest": digest,
        "payload_bytes": len(body) if kind == "response" else None if length is None else int(length), "payload": body if kind == "response" else None,
    }


class _Window:
    """A file's bytes from a start on, read as far as asked; places are the file's.

    What lies before a dropped place is let go once in a while, not for each record.
    """

    def __init__(self, file, start: int):
        self.file, self.start, self.data = file, start, bytearray()
        file.seek(start)

    @property
    def end(self) -> int:
        return self.start + len(self.data)

    def more(self) -> bool:
        got = self.file.read(_CHUNK)
        self.data += got
        return bool(got)

    def at(self, place: int, n: int) -> bytes:
        i = place - self.start
        return bytes(memoryview(self.data)[i : i + n])

    def find(self, place: int) -> int:
        """Where the next magic is, from ``place`` on; -1 if none is here yet."""
        i = self.data.find(MAGIC, place - self.start)
        return -1 if i < 0 else self.start + i

    def drop(self, place: int) -> None:
        if place - self.start > 2 * _CHUNK:
            del self.data[: place - self.start]
            self.start = place


def _inflate(window: _Window, at: int, most: int | None = None) -> tuple[bytes, int] | str:
    """The decoded member at ``at`` and where it ends (-1: ``most`` bytes came first), or why there is none."""
    z, parts, got, fed, step = zlib.decompressobj(31), [], 0, at, 4096
    while not z.eof and (most is None or got < most):
        if fed >= window.end and not window.more():
            return "cut off"
        data = window.at(fed, step)
        fed += len(data)
        try:
            parts.append(z.decompress(data))
        except zlib.error:
            return "no member"
        got += len(parts[-1])
        step = min(2 * step, _CHUNK)
    return b"".join(parts), fed - len(z.unused_data) if z.eof else -1


def whole_record(raw: bytes) -> bool:
    """Whether a decoded member is one WARC record of the length that its header states."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        return False
    length = [x[15:].strip() for x in head.split(b"\r\n")[1:] if x[:15].lower() == b"content-length:"]
    if len(length) != 1 or not length[0].isdigit():
        return False
    return len(rest) >= int(length[0]) and not rest[int(length[0]) :].strip(b"\r\n")


def read_range(file, start: int, end: int, known: bool | None = None) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and decoded bytes of the records that start in [start, end).

    A place counts as a record if it decodes to its end, to a WARC header and
    the length that this states; anything else, a damaged member too, is
    passed over.  ``known`` says that no record lies across ``start`` (as
    none does at 0): then a record cut off by the file's end is an error.
    """
    known = start == 0 if known is None else known
    window, at = _Window(file, start), start
    while at < end:
        i = window.find(at)
        if i < 0:
            at = max(at, window.end - 2)
            window.drop(at)
            if not window.more():
                return
            continue
        if i >= end:
            return
        got = _inflate(window, i, 5)
        if not isinstance(got, str) and got[0].startswith(b"WARC/"):
            got = _inflate(window, i)
            if known and got == "cut off":
                raise EOFError(f"a record at {i} is cut off")
            if not isinstance(got, str) and whole_record(got[0]):
                yield i, got[1] - i, got[0]
                at = got[1]
                window.drop(at)
                continue
        at = i + 1


def settled(spans: Sequence[tuple[int, int, int, int]], walk: Callable[[int, int], tuple[int, int]]) -> list[tuple[int, int, int]]:
    """One file's ranges that own records, as (start, end, from); the records begin at ``from``.

    ``spans`` are all its ranges in order, as (start, end, first, next): what
    looking from ``start`` on gave, -1 if nothing.  Nothing lies across the
    file's beginning, so what is known goes on from there: a range that looked
    from behind the last record on, or found nothing before its end, is
    right; any other is looked at again by ``walk(from, end)``.
    """
    place, out = 0, []
    for start, end, first, after in spans:
        if place >= end:
            continue  # all of it lies in a record that began before
        if 0 <= first < place:
            first, after = walk(place, end)
        if first >= 0:
            out.append((start, end, first))
            place = after
    return out


def _walk(file, start: int, end: int) -> tuple[int, int]:
    """The first record of a range and where its last one ends; -1 if it has none."""
    first = after = -1
    for offset, length, _ in read_range(file, start, end, known=False):
        first, after = offset if first < 0 else first, offset + length
    return first, after


_SPANS = pa.schema([("path", pa.string()), *((n, pa.int64()) for n in ("start", "end", "first", "next"))])
_OWNED = pa.schema([("path", pa.string()), *((n, pa.int64()) for n in ("start", "end", "from"))])


def owned_ranges(archives: DataFrame, split: int) -> DataFrame:
    """``path``, ``start``, ``end``, ``from`` of the ranges that own records.

    An archive of one range needs no look.  Those of others are walked in
    parallel, and what the walks found (a row a range) is put in order archive by archive.
    """
    n = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                fs, at = file_system(row["path"])
                with fs.open_input_file(at) as file:
                    rows.append(row | dict(zip(("first", "next"), _walk(file, row["start"], row["end"]))))
            yield pa.RecordBatch.from_pylist(rows, schema=_SPANS)

    def order(table: pa.Table) -> pa.Table:
        rows = table.sort_by("start").to_pylist()
        path = rows[0]["path"]

        def again(start: int, end: int) -> tuple[int, int]:
            fs, at = file_system(path)
            with fs.open_input_file(at) as file:
                return _walk(file, start, end)

        kept = settled([(r["start"], r["end"], r["first"], r["next"]) for r in rows], again)
        return pa.Table.from_pylist([{"path": path, "start": a, "end": b, "from": c} for a, b, c in kept], schema=_OWNED)

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long")))
    ranges = archives.where(F.col("bytes") > split).select("path", "bytes", starts.alias("start")).select("path", "start", F.least(F.col("start") + split, "bytes").alias("end"))
    spans = ranges.repartition(n, F.xxhash64("path", "start")).mapInArrow(walk, "path string, start long, end long, first long, next long")
    several = spans.groupBy("path").applyInArrow(order, "path string, start long, end long, from long")
    one = archives.where(F.col("bytes").between(1, split)).select("path", F.lit(0).cast("long").alias("start"), F.col("bytes").alias("end"), F.lit(0).cast("long").alias("from"))
    return one.union(several)


def read_archives(archives: DataFrame, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """The records of ``archives`` (``path``, ``bytes``), as ``RECORDS``.

    Ranges of ``split`` bytes are spread over the tasks.  The payload's digest
    is computed from what is read; a revisit's comes from its header.  Empty
    archives and an empty table give no records; payloads of any length are
    read whole; equal records of one archive or several are each a row.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.name, {"long": pa.int64(), "binary": pa.binary()}.get(f.dataType.typeName(), pa.string())) for f in RECORDS])
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = file_system(row["path"])
                with fs.open_input_file(at) as file:
                    rows, held = [], 0
                    for offset, length, raw in read_range(file, row["from"], row["end"], known=True):
                        record = parse_record(raw) | {"path": row["path"], "offset": offset, "length": length}
                        if not payloads:
                            record["payload"] = None
                        rows.append(record)
                        held += len(raw) if payloads else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # written once: the walks aren't repeated by whoever reads the records twice
    owned = checkpointed(owned_ranges(archives, split))
    return owned.repartition(n, F.xxhash64("path", "start")).mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, folder: str | None = None, split: int = SPLIT) -> DataFrame:
    """Write ``pages`` as archives and read back their records, without bodies."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(mark_revisits(pages), folder), split, payloads=False)


