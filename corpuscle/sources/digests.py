"""SHA-256 of files too large for one task: their stretches are hashed one after another, the hash's state goes from task to task.

Spark's text source cuts a file into stretches of whole lines, by the bytes alone with a line feed as the only separator. It leaves
out lines of `LONGEST` bytes and more; what is hashed must add up to the file's length, or there is no result. The state is that of OpenSSL, which Python's `hashlib`
uses itself but does not hand out.
"""

from __future__ import annotations

import _hashlib
import ctypes
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONGEST = 1 << 25
_STATE = 112
_MARK = b"\xef\xbb\xbf"  # the text source leaves it out at the start of a file
PACKED = re.compile(r"\.(gz|bz2|deflate|lz4|snappy|zst|lzo)$", re.IGNORECASE)  # the text source would unpack these


class Sha256:
    """A hash whose state is bytes that another process can go on with."""

    def __init__(self, state: bytes | None = None):
        self._crypto = ctypes.CDLL(_hashlib.__file__)
        self._state = ctypes.create_string_buffer(state or b"", _STATE)
        if state is None:
            self._crypto.SHA256_Init(self._state)

    def update(self, data: bytes | int, size: int | None = None) -> Sha256:
        """Take `data`, or `size` bytes at an address."""
        where = ctypes.c_char_p(data) if size is None else ctypes.c_void_p(data)
        self._crypto.SHA256_Update(self._state, where, ctypes.c_size_t(len(data) if size is None else size))
        return self

    @property
    def state(self) -> bytes:
        return self._state.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self._crypto.SHA256_Final(out, ctypes.create_string_buffer(self.state, _STATE))
        return out.raw.hex()


def available() -> bool:
    return hasattr(ctypes.CDLL(_hashlib.__file__), "SHA256_Update")


def _stretch(lines: DataFrame, state: bytes, open_line: bool) -> DataFrame:
    """(start, size, open_line, state) after each of the file's partitions, if hashed from the state given.

    Whether a line ends with a line feed is only known when another follows, so a partition's last one is left open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, size, start, open_ = Sha256(state), 0, None, open_line
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("bytes").cast(pa.large_binary())
            first, last = (int.from_bytes(column.buffers()[1][8 * i : 8 * i + 8].to_pybytes(), "little") for i in (column.offset, column.offset + len(column)))
            if open_:
                digest.update(b"\n")
            digest.update(column.buffers()[2].address + first, last - first - 1)
            start = batch.column("start")[0].as_py() if start is None else start
            size, open_ = size + last - first, True
        columns = [pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([open_]), pa.array([digest.state], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["start", "size", "open_line", "state"])

    return lines.mapInArrow(run, "start bigint, size bigint, open_line boolean, state binary")


def literal(path: str) -> str:
    """A path that Spark does not take as a pattern."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def file_digest(spark: SparkSession, path: str, length: int) -> str | None:
    """The SHA-256 of one file, a job for each of its partitions; None if its lines are too long."""
    reader = spark.read.option("lineSep", "\n").option("mapreduce.input.linerecordreader.line.maxlength", str(LONGEST))
    lines = reader.text(literal(path)).select(
        F.concat(F.col("value").cast("binary"), F.lit(bytearray(b"\n"))).alias("bytes"), F.col("_metadata.file_block_start").alias("start")
    )
    for mark in (b"", _MARK):
        state, size, open_line, before = Sha256().update(mark).state, len(mark), False, -1
        for i in range(lines.rdd.getNumPartitions()):
            rows = _stretch(lines, state, open_line).rdd
            (r,) = spark.sparkContext.runJob(rows, list, [i])
            if r["start"] is None:  # a line goes on over the whole stretch
                continue
            if r["start"] <= before:
                raise RuntimeError(f"the stretches of {path} are not in order")
            state, size, open_line, before = bytes(r["state"]), size + r["size"], r["open_line"], r["start"]
        if size == length:
            return Sha256(state).update(b"\n" if open_line else b"").hexdigest()
        if size == length + 1:
            return Sha256(state).hexdigest()
    return None


def file_digests(spark: SparkSession, files: list[tuple[str, int]]) -> list[tuple[str, str | None]]:
    """(path, SHA-256 or None) of files given as (path, length). A file's jobs follow each other, those of several files run at once."""
    with ThreadPoolExecutor(max(1, min(len(files), spark.sparkContext.defaultParallelism))) as pool:
        return list(pool.map(lambda f: (f[0], file_digest(spark, *f)), files))
