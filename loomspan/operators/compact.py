"""Many small files into few well-sized ones, by bytes.

Files are joined newline to newline into complete zstandard frames, with their place, length and checksum
in a manifest beside each frame; nothing is parsed. Frames are moved whole into packs of the size that
spark.sql.adaptive.advisoryPartitionSizeInBytes asks for. Reading a pack checks every length and checksum.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators import json_index as J
from loomspan.operators.nested import _members, _named, texts
from loomspan.session import written

BOM = b"\xef\xbb\xbf"
#: Raw bytes of a frame: what a reader holds at once.
FRAME_BYTES = 1 << 20
PACK_SCHEMA = (
    "frame binary, raw_bytes bigint, raw_check bigint, file_id array<bigint>, modified_at array<timestamp_ntz>, "
    "offset array<bigint>, length array<bigint>, header array<int>, check array<bigint>"
)
_PACK_ARROW = pa.schema(
    [("frame", pa.binary()), ("raw_bytes", pa.int64()), ("raw_check", pa.int64()), ("file_id", pa.list_(pa.int64())), ("modified_at", pa.list_(pa.timestamp("us"))),
     ("offset", pa.list_(pa.int64())), ("length", pa.list_(pa.int64())), ("header", pa.list_(pa.int32())), ("check", pa.list_(pa.int64()))]
)


def checksum(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def _frame(raw: bytearray, members: list[tuple]) -> pa.RecordBatch:
    body = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True).compress(bytes(raw))
    lists = [list(x) for x in zip(*members)]
    return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip([body, len(raw), checksum(bytes(raw)), *lists], _PACK_ARROW)], schema=_PACK_ARROW)


def _pack(batches: Iterable[pa.RecordBatch], frame_bytes: int) -> Iterator[pa.RecordBatch]:
    raw, members = bytearray(), []
    for batch in batches:
        content = batch.column("content").cast(pa.binary())
        for file_id, modified, body in zip(batch.column("file_id").to_pylist(), batch.column("modified_at").to_pylist(), content.to_pylist()):
            if body is None:
                members.append((file_id, modified, len(raw), -1, 0, 0))
            else:
                header = 3 if body.startswith(BOM) else 0
                members.append((file_id, modified, len(raw), len(body) - header, header, checksum(body)))
                raw += body[header:]
                if not body.endswith(b"\n"):
                    raw += b"\n"
            if len(raw) >= frame_bytes:
                yield _frame(raw, members)
                raw, members = bytearray(), []
    if members:
        yield _frame(raw, members)


def pack(files: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Frames of files (file_id, modified_at, content STRING or BINARY). One pass, no shuffle, no parsing.

    An empty file keeps its entry with length 0, a null content one with length -1; a byte order mark is taken
    off the joined bytes and noted as header, so that a file comes back byte for byte. A file above frame_bytes
    has a frame of its own. Rows with equal file_id are kept as they are.
    """
    files = files.select(F.col("file_id").cast("bigint"), F.col("modified_at").cast("timestamp_ntz"), "content")
    return files.mapInArrow(lambda batches: _pack(batches, frame_bytes), PACK_SCHEMA)


def compact(files: DataFrame, frame_bytes: int = FRAME_BYTES, folder: str | None = None) -> DataFrame:
    """The packs of files, written to folder, which must not exist yet; frames are merged into few files by adaptive rebalancing.

    Without a folder they are an intermediate table of the shared folder. Read them again by spark.read.parquet(folder).
    """
    return written(pack(files, frame_bytes).hint("rebalance"), "packs", folder, compression="none")


def open_frame(frame: bytes, raw_bytes: int, raw_check: int) -> bytes:
    """A frame's joined bytes; ValueError if length or checksum is off."""
    raw = zstandard.ZstdDecompressor().decompress(frame, max_output_size=max(raw_bytes, 1)) if raw_bytes else b""
    if len(raw) != raw_bytes or checksum(raw) != raw_check:
        raise ValueError(f"frame of {raw_bytes} bytes is damaged")
    return raw


def members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (file_id, modified_at, content) of each frame's files, every length and checksum checked."""
    for batch in batches:
        for row in range(batch.num_rows):
            r = {f.name: batch.column(f.name)[row] for f in _PACK_ARROW}
            raw = open_frame(r["frame"].as_py(), r["raw_bytes"].as_py(), r["raw_check"].as_py())
            bodies = []
            for at, size, header, check in zip(*(r[c].as_py() for c in ("offset", "length", "header", "check"))):
                body = None if size < 0 else BOM[:header] + raw[at : at + size]
                if body is not None and (len(body) != size + header or checksum(body) != check):
                    raise ValueError(f"a file of {size} bytes is damaged")
                bodies.append(body)
            yield pa.RecordBatch.from_arrays([r["file_id"].values, r["modified_at"].values, pa.array(bodies, pa.binary())], names=["file_id", "modified_at", "content"])


def unpack(packs: DataFrame) -> DataFrame:
    """The files of packs again, byte for byte."""
    return packs.mapInArrow(members, "file_id bigint, modified_at timestamp_ntz, content binary")


def concat_frames(frames: Iterable[bytes]) -> bytes:
    """Complete zstandard frames end to end, which is again a zstandard stream; ValueError if one isn't complete."""
    out = []
    for frame in frames:
        size = zstandard.frame_content_size(frame)
        reader = zstandard.ZstdDecompressor().decompressobj()
        if size < 0 or (size and len(reader.decompress(frame)) != size) or (size and not reader.eof):
            raise ValueError("not a complete frame with its size in the header")
        out.append(frame)
    return b"".join(out)


def export(packs: DataFrame, folder: str) -> DataFrame:
    """Each partition of packs as one file folder/pack-N.ndjson.zst; gives (path, n_bytes, n_files).

    folder is a URI of any file system that pyarrow knows (hdfs, s3, gs, file), or a path on a mounted shared one; executors write there themselves.
    A file appears under its name only when complete, so that a task that runs again does no harm.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        context = TaskContext.get()
        path = f"{root.rstrip('/')}/pack-{context.partitionId():05d}.ndjson.zst"
        part, files, size = f"{path}.{context.taskAttemptId()}.part", 0, 0
        with system.open_output_stream(part) as out:
            for batch in batches:
                for frame, ids in zip(batch.column("frame").to_pylist(), batch.column("file_id").to_pylist()):
                    size += out.write(concat_frames([frame]))
                    files += len(ids)
        system.move(part, path)
        yield pa.RecordBatch.from_pydict({"path": [path], "n_bytes": [size], "n_files": [files]})

    return packs.mapInArrow(write, "path string, n_bytes bigint, n_files bigint")


def _records(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Complete state records of files: (file_id, modified_at, place, run_id, statuses)."""
    content = batch.column("content").cast(pa.string())
    t = J.index(content, by_line=True)
    if not len(t.kind):
        return None
    objects = np.flatnonzero((t.kind == J.OBJ) & (t.match >= 0))
    flaws = np.concatenate([[0], np.cumsum(~t.ok)])
    objects = objects[flaws[t.match[objects] + 1] == flaws[objects + 1]]
    values = np.flatnonzero(t.is_value & (t.container >= 0))
    inner, owner = _members(t, values, objects)
    run, attempts = np.full(len(objects), -1), np.full(len(objects), -1)
    at = np.isin(inner, _named(t, inner, "run_id"))
    run[owner[at]] = inner[at]
    at = np.isin(inner, _named(t, inner, "attempts"))
    attempts[owner[at]] = inner[at]
    keep = (run >= 0) & (attempts >= 0)
    objects, run, attempts = objects[keep], run[keep], attempts[keep]
    if not len(objects):
        return None
    outer = np.maximum.accumulate(np.concatenate([[-1], t.match[objects][:-1]]))
    top = objects > outer  # a record inside a record is part of it
    objects, run, attempts = objects[top], run[top], attempts[top]
    run_id = J.span_integer(t.data, *J.inner_spans(t, run))
    items, of = _members(t, values, attempts)
    keep = t.kind[items] == J.OBJ
    items, of = items[keep], of[keep]
    fields, at = _members(t, values, items)
    keep = np.isin(fields, _named(t, fields, "status"))
    status = np.full(len(items), None, object)
    status[at[keep]] = texts(t, fields[keep])
    order = np.lexsort((items, of))
    sizes = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(objects)))])
    rows = pa.array(t.doc[objects])
    return pa.RecordBatch.from_arrays(
        [batch.column("file_id").take(rows), batch.column("modified_at").take(rows), pa.array(t.start[objects]), pa.array(run_id), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(status[order], pa.string()))],
        names=["file_id", "modified_at", "place", "run_id", "statuses"],
    )


RECORDS_SCHEMA = "file_id bigint, modified_at timestamp_ntz, place bigint, run_id bigint, statuses array<string>"


def records(packs: DataFrame) -> DataFrame:
    """Every complete state record in packs: an object with run_id and attempts whose own text is whole.

    Found by the structural index over whole files, so also behind a cut-off record, in a list or pretty-printed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in members(batches):
            if (out := _records(batch)) is not None:
                yield out

    return packs.mapInArrow(run, RECORDS_SCHEMA)


def latest(df: DataFrame, key: str, order: list[Column], value: str) -> DataFrame:
    """Of each key the value of the row that is last in order; null keys give no row."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def consolidated_attempts(packs: DataFrame) -> DataFrame:
    """(run_id, attempt_no, status): attempts of each run's latest complete record, each exactly once.

    Latest by the file's modified_at; ties go to the larger file_id, then the later place. A record without
    attempts counts as the latest all the same. A status that is missing or null comes out null.
    """
    last = latest(records(packs).where("run_id >= 0"), "run_id", [F.col("modified_at"), F.col("file_id"), F.col("place")], "statuses")
    return last.select("run_id", F.posexplode("statuses").alias("attempt_no", "status")).withColumn("attempt_no", (F.col("attempt_no") + 1).cast("int"))


def pack_report(packs: DataFrame) -> DataFrame:
    """For each frame its files and bytes, raw and packed, with the checksum that readers hold it against."""
    return packs.select(
        F.col("raw_check"), "raw_bytes", F.length("frame").cast("bigint").alias("packed_bytes"), F.size("file_id").cast("bigint").alias("n_files"),
        F.expr("aggregate(length, 0L, (a, x) -> a + greatest(x, 0L))").alias("file_bytes"),
    )
