"""Shared helpers: scratch tables, whole-text word hashing on Arrow columns, small-side joins."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python classes of the white space that parts words: space and tab to carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
#: Values that are hashed at a time, about; only powers up to that number are kept in a worker.
CHUNK = 1 << 20
_powers: dict[tuple[int, bool], np.ndarray] = {}
#: Rows of texts in an Arrow batch at most, so that a worker holds a few MB of them.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where none is set, a local master gets a local one; a cluster is told to set it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> DataFrame:
    """`df`, a staged table, after two collections of garbage, by which Spark drops the shuffle files that led to it.

    The first one frees what Python held; the second one, a second later, finds the shuffles unused.
    """
    for wait in (1, 0):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(wait)
    return df


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only where a count shows at most `max_rows` rows; else Spark's own choice of join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def words_of(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of a text; null text gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


# ---------------------------------------------------------------- Arrow text columns


def map_texts(source: DataFrame, run, schema) -> DataFrame:
    """mapInArrow for rows with whole texts: sets the session's Arrow batches to BATCH_ROWS rows at most."""
    conf = source.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return source.mapInArrow(run, schema)


def text_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of whole texts of about `most` bytes; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        to = min(to, n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def byte_class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Bytes that belong to words.
WORD = ~byte_class(b" \t\n\x0b\x0c\r")


def find_words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = WORD):
    """Start, end and row of each maximal run of member bytes; runs never cross a row."""
    inside = member[data]
    if not len(data) or not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(end) + 1, np.searchsorted(offsets, start, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each bit of a 64-bit value over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(which: int, inverse: bool, n: int) -> np.ndarray:
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = _MULTIPLIERS[which] | 1
        if inverse:
            base = pow(base, -1, 1 << 64)
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if size <= CHUNK:
            _powers[which, inverse] = have
    return have[:n]


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of values[start:end] for many spans, by prefix sums of a polynomial; long inputs go in parts."""
    n = len(values)
    if n > 2 * CHUNK and len(start) > 1 and (np.diff(start) >= 0).all():
        out = np.empty(len(start), np.uint64)
        i = 0
        while i < len(start):
            j = int(np.searchsorted(start, start[i] + CHUNK))
            low, high = start[i], end[i:j].max()
            out[i:j] = _span_hash(values[low:high], start[i:j] - low, end[i:j] - low, which)
            i = j
        return out
    return _span_hash(values, start, end, which)


def _span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power(which, False, max(n, 1))[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * _power(which, True, n + 1)[start] + (end - start).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
