"""WARC archives: writing with one gzip stream a file, normalising to one gzip member a record, reading by offset.

Writing: each group of rows becomes one archive ``part-NNNNN.warc.gz`` whose records share one gzip stream, as careless
writers leave them. Normalising: the stream is inflated once, record after record; each record is written again as a
member of its own, and the sidecar ``part-NNNNN.cdx`` lists for each its offset, length and header fields. Reading: the
members are inflated from the offsets of the sidecar.

Of records with equal payloads of at least ``least`` bytes, the one with the smallest id is a response; the others are
revisits without a payload that name it. They are found by a grouping on digest and length, for which payloads stay where
they are; payloads are shuffled once, by archive, and meet there what was found of their rows.

Files are written by the tasks to a folder that all share, under a name of the attempt first and then renamed, so that a
task that runs again leaves the same archive. A stream goes once its normalised archive is in place. Any folder that
pyarrow's file systems open can serve; without one of the caller's, all goes when the application ends.

Defined cases: a null payload is empty; a null id sorts last, is written as an empty header and read as null, also where a
revisit refers to it; repeated rows are records of their own (of equal ids and payloads the one with the least url hash is
the response, of rows equal in all three one); other columns are left out, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import goes_at_end, group_count, shared_folder

#: Payload MB in an archive and in a task, and gzip's effort.
ARCHIVE_MB, TASK_MB, LEVEL = 8, 64, 4
GZIP = 31
#: Date of every record: archives of equal rows are equal.
DATE = "2024-01-01T00:00:00Z"
ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, archive string, offset long, length long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, size: int, refers_to: int | None, original: bool) -> bytes:
    """One WARC/1.1 record; a revisit has no block."""
    name = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').translate({10: '%0A', 13: '%0D'})}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {size}",
    ]
    if not original:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    block = payload if original else b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    return fields, rest[: int(fields["content-length"])]


def split_stream(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream, holding one record and one chunk at a time."""
    held = bytearray()
    need = 0
    for chunk in chunks:
        held += chunk
        while True:
            if not need:
                if (at := held.find(b"\r\n\r\n")) < 0:
                    break
                size = next(x for x in bytes(held[:at]).decode().split("\r\n") if x.lower().startswith("content-length:"))
                need = at + 4 + int(size.partition(":")[2]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0


def inflate(source, size: int = 1 << 20) -> Iterator[bytes]:
    """The inflated bytes of a gzip file of any number of members."""
    engine = zlib.decompressobj(GZIP)
    while data := source.read(size):
        while data:
            yield engine.decompress(data)
            data = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(GZIP)


def member(data: bytes) -> bytes:
    engine = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return engine.compress(data) + engine.flush()


def normalise(source, target, index) -> None:
    """Rewrite a gzipped archive with a member a record; ``index`` gets a line of offset, length and record id each."""
    at = 0
    for data in split_stream(inflate(source)):
        packed = member(data)
        target.write(packed)
        fields, _ = parse(data)
        index.write(f"{at} {len(packed)} {fields['warc-type']} {fields['warc-record-id']}\n".encode())
        at += len(packed)


def _file_system(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa.fs.LocalFileSystem(), folder)


def sized_rows(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url and payload (bytes) of each row, its digest sha and size, and tie, which parts rows of one id."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    return rows.withColumns({"sha": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long"), "tie": F.xxhash64("url")})


def revisits(sized: DataFrame, least: int = 0) -> DataFrame:
    """my_id, my_tie, my_sha of rows whose payload several rows hold, and first_id and first_tie of the first of those; lean rows only."""
    lean = sized.where(F.col("size") >= least).select("page_id", "tie", "sha", "size")
    rank = F.struct(F.col("page_id").isNull(), "page_id", "tie")
    first = lean.groupBy("sha", "size").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return lean.join(first, ["sha", "size"]).select(F.col("page_id").alias("my_id"), F.col("tie").alias("my_tie"), F.col("sha").alias("my_sha"), F.col("first.page_id").alias("first_id"), F.col("first.tie").alias("first_tie")).distinct()


def write_archives(sized: DataFrame, again: DataFrame, folder: str) -> DataFrame:
    """Write ``sized`` rows as monolithic gzipped archives under ``folder``, those that ``again`` lists as revisits of their first; a row (archive, records) each."""
    groups = group_count(sized, F.col("payload"), ARCHIVE_MB)

    def write(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"archive": pa.array([], pa.string()), "records": pa.array([], pa.int64())})
        fs, base = _file_system(folder)
        name = f"part-{table.column('archive')[0].as_py():07d}.warc.gz"
        fs.create_dir(base, recursive=True)
        draft = f"{base}/.{name}.{uuid.uuid4().hex}"
        firsts = dict(zip(zip(*(known.column(c).to_pylist() for c in ("my_id", "my_tie", "my_sha")), strict=True), zip(*(known.column(c).to_pylist() for c in ("first_id", "first_tie")), strict=True), strict=True))
        engine = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
        rows = table.sort_by([("page_id", "ascending"), ("sha", "ascending"), ("tie", "ascending"), ("url", "ascending")])
        before = None
        with fs.open_output_stream(draft, compression=None) as out:
            for batch in rows.to_batches(max_chunksize=64):
                for x in batch.to_pylist():
                    me = (x["page_id"], x["tie"], x["sha"])
                    first = firsts.get(me)
                    # rows equal in all that is looked at lie together: the first of them is the response
                    original = first is None or (first == (x["page_id"], x["tie"]) and me != before)
                    before = me
                    out.write(engine.compress(record(x["page_id"], x["url"], x["payload"], base64.b32encode(x["sha"]).decode(), x["size"], None if original else first[0], original)))
            out.write(engine.flush())
        fs.move(draft, f"{base}/{name}")
        return pa.table({"archive": [f"{base}/{name}"], "records": pa.array([table.num_rows], pa.int64())})

    rows = sized.withColumn("archive", F.pmod(F.xxhash64("page_id", "tie", "sha"), F.lit(groups)))
    known = again.withColumn("archive", F.pmod(F.xxhash64("my_id", "my_tie", "my_sha"), F.lit(groups)))
    tasks = math.ceil(groups * ARCHIVE_MB / TASK_MB)
    if tasks > int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")):  # so that a task reads as much at every size
        rows, known = rows.repartition(tasks, "archive"), known.repartition(tasks, "archive")
    return rows.groupBy("archive").cogroup(known.groupBy("archive")).applyInArrow(write, "archive string, records long")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive under ``folder`` with a member a record and a sidecar index; a row (archive, index) each."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            done = []
            for path in batch.column("archive").to_pylist():
                name = path.rpartition("/")[2]
                draft = f"{base}/.{name}.{uuid.uuid4().hex}"
                index = io.BytesIO()
                if fs.get_file_info(path).type == pa.fs.FileType.NotFound and fs.get_file_info(f"{base}/{name}").is_file:
                    done.append(f"{base}/{name}")  # another attempt has finished
                    continue
                with fs.open_input_stream(path, compression=None) as source, fs.open_output_stream(draft, compression=None) as target:
                    normalise(source, target, index)
                with fs.open_output_stream(f"{draft}.cdx", compression=None) as out:
                    out.write(index.getvalue())
                fs.move(f"{draft}.cdx", f"{base}/{name}.cdx")
                fs.move(draft, f"{base}/{name}")
                fs.delete_file(path)
                done.append(f"{base}/{name}")
            yield pa.record_batch({"archive": pa.array(done, pa.string()), "index": pa.array([f"{x}.cdx" for x in done], pa.string())})

    return archives.select("archive").mapInArrow(rewrite, "archive string, index string")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A row a record of the normalised archives, each member inflated from its offset."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(folder)
        number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
        for batch in batches:
            for path, sidecar in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist(), strict=True):
                with fs.open_input_stream(sidecar, compression=None) as source:
                    lines = [x.split(" ", 3) for x in source.read().decode().splitlines()]
                rows = []
                with fs.open_input_file(path) as source:
                    for i, (at, size, _, _) in enumerate(lines):
                        source.seek(int(at))
                        fields, block = parse(zlib.decompress(source.read(int(size)), GZIP))
                        original = fields["warc-type"] == "response"
                        rows.append(
                            {
                                "page_id": number(fields["warc-record-id"]),
                                "payload_bytes": int(fields["x-payload-length"]),
                                "payload_digest": digest(block) if original else fields["warc-payload-digest"].removeprefix("sha1:"),
                                "record_type": fields["warc-type"],
                                "refers_to": None if original else number(fields["warc-refers-to"]),
                                "url": fields["warc-target-uri"],
                                "payload": block,
                                "archive": path,
                                "offset": int(at),
                                "length": int(size),
                            }
                        )
                        if len(rows) == 64 or i == len(lines) - 1:
                            yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                            rows = []

    return archives.select("archive", "index").mapInArrow(read, ROW)


SCHEMA = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in ROW.split(", "))])


def warc_round_trip(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, normalise these and read them: a row a record, as ``ROW`` says."""
    base = folder or goes_at_end(pages.sparkSession, f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}")
    # plain local paths are as good as file:, and what pyarrow opens everywhere
    base = base.removeprefix("file://") if base.startswith("file:///") else base.removeprefix("file:")
    sized = sized_rows(pages)
    written = write_archives(sized, revisits(sized, least), f"{base}/streams")
    return read_archives(normalise_archives(written, f"{base}/records"), f"{base}/records")
