"""Files too large for one row: their SHA-256, and the bytes that their headers need, by byte ranges."""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Iterator

import _hashlib
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.images import JPEG_REACH, MAGIC, TAIL, TIFF_REACH, header

#: Bytes of a row; a task's batch holds some thousands of rows.
CHUNK = 1 << 14
#: Files that Spark's text source would unpack.
PACKED = r"(?i)\.(gz|gzip|bz2|deflate|snappy|lz4|zst|passthrough)$"
BOM = b"\xef\xbb\xbf"
KIND = "file string, size long, block long, i long, data binary"
STATE = "file string, size long, at long, lo long, hi long, state binary, data binary"
STATE_ARROW = [("file", pa.string()), *[(c, pa.int64()) for c in ("size", "at", "lo", "hi")], ("state", pa.binary()), ("data", pa.binary())]


@functools.cache
def _library():
    """The libcrypto that hashlib uses: its SHA-256 can be stopped and taken up again, which hashlib's cannot."""
    lib = ctypes.CDLL(_hashlib.__file__)
    for name in ("SHA256_Init", "SHA256_Update", "SHA256_Final"):
        getattr(lib, name)
    lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
    lib.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
    lib.SHA256_Init.argtypes = [ctypes.c_void_p]
    return lib


class Sha256:
    """SHA-256 whose state is bytes."""

    SIZE = 128  # SHA256_CTX has 112

    def __init__(self, state: bytes | None = None):
        self.state = ctypes.create_string_buffer(state or b"", self.SIZE)
        if state is None:
            _library().SHA256_Init(self.state)

    def update(self, data: bytes) -> None:
        _library().SHA256_Update(self.state, data, len(data))

    def hexdigest(self) -> str:
        out, copy = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.state.raw, self.SIZE)
        _library().SHA256_Final(out, copy)
        return out.raw.hex()


@functools.cache
def resumable() -> bool:
    """Whether this machine's library is what Sha256 takes it for."""
    try:
        h = Sha256()
        h.update(b"ab" * 99)
        h = Sha256(h.state.raw)
        h.update(b"c")
        return h.hexdigest() == hashlib.sha256(b"ab" * 99 + b"c").hexdigest()
    except (OSError, AttributeError):
        return False


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a task, with their line feeds, as rows of CHUNK bytes or a little more; a byte range ends a row."""
    held, own, n, i = [], None, 0, 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array([own[0]]), pa.array([own[1]]), pa.array([own[2]]), pa.array([i]), pa.array([b"".join(held)], pa.binary())], names=["file", "size", "block", "i", "data"])
    for batch in batches:
        files, sizes, blocks = (batch.column(c).to_pylist() for c in ("file", "size", "block"))
        for file, size, block, line in zip(files, sizes, blocks, batch.column("value").to_pylist()):
            if held and (own != (file, size, block) or n >= CHUNK):
                yield make()
                held, n, i = [], 0, i + 1
            own = (file, size, block)
            held += (line, b"\n")
            n += len(line) + 1
    if held:
        yield make()


def _wanted(first: bytes) -> tuple[int, int]:
    """The bytes, beside the first chunk's and the last ones, where a file that begins so has its header."""
    start = lambda k: first.startswith(bytes.fromhex(MAGIC[k]))
    if start("jpeg"):
        return 0, JPEG_REACH
    if start("tiff-le") or start("tiff-be"):
        lo = int.from_bytes(first[4:8], "little" if start("tiff-le") else "big")
        return lo, lo + TIFF_REACH
    return 0, 0


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by file: a file's state (block -1) with the number of bytes it has seen, then further bytes. Gives the
    new states, and, beside them, bytes that the header needs, with their place."""
    file, size, done, h, lo, hi = None, 0, 0, None, 0, 0

    def row(at: int, state: bytes | None, data: bytes | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": file, "size": size, "at": at, "lo": lo, "hi": hi, "state": state, "data": data}], schema=pa.schema(STATE_ARROW))

    for batch in batches:
        for r in batch.to_pylist():
            if r["block"] < 0:
                if h is not None:
                    yield row(done, h.state.raw, None)
                file, size, done, h, lo, hi = r["file"], r["size"], r["i"], Sha256(r["data"]), r["lo"], r["hi"]
                continue
            part = r["data"][: size - done]  # the last line may have had no line feed
            h.update(part)
            if done == 0:
                lo, hi = _wanted(part)
            if part and (done == 0 or done + len(part) > size - TAIL or done < hi and done + len(part) > lo):
                yield row(done, None, part)
            done += len(part)
    if h is not None:
        yield row(done, h.state.raw, None)


def _contents(pieces: pa.Table) -> pa.Table:
    """(file, content, end) of one file's pieces: content has the header of the file, and end its last bytes."""
    rows = sorted(pieces.to_pylist(), key=lambda r: r["at"])
    lo, hi = max((r["lo"], r["hi"]) for r in rows)
    first = rows[0]["data"] if rows[0]["at"] == 0 else b""
    near = [r for r in rows if r["at"] < hi and r["at"] + len(r["data"]) > lo]
    body = b"".join(r["data"] for r in near)
    if hi and lo == 0:
        first = body
    elif hi:  # a TIFF: its directory follows at once
        own = body[lo - near[0]["at"] :] if near else b""
        first = first[:4] + (8).to_bytes(4, "little" if first[:1] == b"I" else "big") + own
    end = b"".join(r["data"] for r in rows[-TAIL:])[-TAIL:]
    return pa.table({"file": [rows[0]["file"]], "content": pa.array([first], pa.binary()), "end": pa.array([end], pa.binary())})


def _digest(states: pd.Series) -> pd.Series:
    return states.map(lambda s: Sha256(s).hexdigest())


def large_files(lines: DataFrame, reach: int) -> DataFrame:
    """(path, size, sha256, h) of the files over reach bytes among those of lines, a text source cut at line feeds.

    A hash takes its bytes in order, but not in one task: files come in the text source's byte ranges and are written
    in steps of reach bytes. Step after step takes up the states that the one before left, of all files at once; no
    task reads more of a file than one step. A stretch without a line feed is not cut.
    """
    from .io import kept, scratch

    spark = lines.sparkSession
    meta = lambda c: F.col(f"_metadata.{c}")
    lines = lines.filter((meta("file_size") > reach) & ~meta("file_path").rlike(PACKED))
    lines = lines.select(meta("file_path").alias("file"), meta("file_size").alias("size"), meta("file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    path = scratch(spark, "large-files")
    lines.mapInArrow(_joined, KIND).withColumn("step", F.floor(F.col("block") / reach).cast("int")).write.option("compression", "none").partitionBy("step").parquet(path)
    chunks = spark.read.schema(f"{KIND}, step int").parquet(path)
    steps = kept(chunks.groupBy("file", "size", "step").agg(F.sum(F.length("data")).alias("n")), "large-steps")
    # the text source passes over a byte order mark
    marked = F.sum("n") < F.col("size") - 1
    none, mark = Sha256(), Sha256()
    mark.update(BOM)
    start = F.when(marked, F.lit(mark.state.raw)).otherwise(F.lit(none.state.raw))
    zero = F.lit(0).cast("long")
    states = steps.groupBy("file", "size").agg(F.when(marked, len(BOM)).otherwise(0).cast("long").alias("at"), start.alias("state"))
    states = kept(states.select("file", "size", "at", zero.alias("lo"), zero.alias("hi"), "state", F.lit(None).cast("binary").alias("data")), "large-states")
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = states.filter("data IS NOT NULL")
    for step in sorted(r["step"] for r in steps.select("step").distinct().collect()):
        before = states.filter("data IS NULL").select("file", "size", F.lit(-1).cast("long").alias("block"), F.col("at").alias("i"), "lo", "hi", F.col("state").alias("data"))
        rows = before.unionByName(chunks.filter(F.col("step") == step).select("file", "size", "block", "i", zero.alias("lo"), zero.alias("hi"), "data"))
        states = kept(rows.repartition(tasks, "file").sortWithinPartitions("file", "block", "i").mapInArrow(_hashed, STATE), "large-states")
        pieces = pieces.unionByName(states.filter("data IS NOT NULL"))
    contents = pieces.groupBy("file").applyInArrow(_contents, "file string, content binary, end binary")
    whole = F.assert_true(F.col("at") == F.col("size"), F.concat(F.lit("not read whole: "), "file"))
    sha = states.filter("data IS NULL").select("file", "size", F.when(whole.isNull(), F.pandas_udf(_digest, "string")("state")).alias("sha256"))
    rows = sha.join(contents, "file", "left")
    name = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))  # _metadata has escapes, a binary file's path has none
    return rows.select(name.alias("path"), "size", "sha256", header(F.col("content"), F.col("size"), F.col("end")).alias("h"))
