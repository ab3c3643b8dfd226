"""Vectors as compact rows.

A vector travels as one binary value. Where every component is a decimal of at most three places (as
exported signatures are) it is kept as scaled 16-bit integers, low bytes first and high bytes after them;
any other vector is kept as its 32-bit floats. Both restore the same floats bit for bit (but for the sign of
zero); the length of the value tells them apart, so nothing else need be stored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

WIDTH = 88
PLACES = 1000.0


def pack(x: np.ndarray) -> pa.Array:
    """Rows of float32 to binary values."""
    n, d = x.shape
    scaled = np.rint(x.astype("f8") * PLACES)
    small = (np.abs(scaled) < 32767).all(1)
    scaled[~small] = 0
    small &= ((scaled / PLACES).astype("f4") == x).all(1)
    size = np.where(small, 2 * d, 4 * d)
    at = np.concatenate([[0], size.cumsum()])
    out = np.empty(at[-1], "u1")
    for mine, width in ((small, 2 * d), (~small, 4 * d)):
        if mine.any():
            raw = scaled[mine].astype("<i2").view("u1").reshape(-1, d, 2).transpose(0, 2, 1).reshape(-1, 2 * d) if width == 2 * d else np.ascontiguousarray(x[mine].astype("<f4")).view("u1")
            out[at[:-1][mine][:, None] + np.arange(width)] = raw
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.astype("i4")), pa.py_buffer(out)])


def unpack(v: pa.Array, d: int = WIDTH) -> np.ndarray:
    """Binary values to rows of float32."""
    if isinstance(v, pa.ChunkedArray):
        v = v.combine_chunks()
    n = len(v)
    if not n:
        return np.empty((0, d), "f4")
    _, offsets, data = v.buffers()
    at = np.frombuffer(offsets, "i4", n + 1, v.offset * 4).astype("i8")
    data, size, x = np.frombuffer(data, "u1"), np.diff(at), np.empty((n, d), "f4")
    for width in (2 * d, 4 * d):
        mine = size == width
        if mine.any():
            raw = data[at[0] : at[-1]].reshape(n, width) if mine.all() else data[at[:-1][mine][:, None] + np.arange(width)]
            x[mine] = np.ascontiguousarray(raw.reshape(-1, 2, d).transpose(0, 2, 1)).view("<i2")[..., 0] / PLACES if width == 2 * d else np.ascontiguousarray(raw).view("<f4")
    return x


def unit(x: np.ndarray, kind: str = "f4") -> np.ndarray:
    x = x.astype("f8")
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(kind)


def _packer(d: int):
    def run(batches):
        for b in batches:
            v = b.column("vec")
            flat = v.flatten()
            good = np.array(v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == d)
            x = np.full((len(v), d), np.nan, "f4")
            if len(flat) and good.any():
                values = flat.cast(pa.float32()).to_numpy(zero_copy_only=False)
                size = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                x[good] = values[np.repeat(good, size)].reshape(-1, d)
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            if ok.any():
                yield pa.RecordBatch.from_arrays([b.column("md5").filter(pa.array(ok)), b.column("built_at").filter(pa.array(ok)), pack(x[ok])], ["md5", "built_at", "v"])

    return run


HEX = "^[0-9a-f]{32}$"


def key_of(md5: Column) -> Column:
    """A file's name as bytes that sort the same: 16 for a hash in hex, else its UTF-8 and, so that no other name has 16 bytes, one or two bytes 0xff."""
    text = F.encode(md5, "utf-8")
    return F.when(md5.rlike(HEX), F.unhex(md5)).when(F.length(text) == 15, F.concat(text, F.unhex(F.lit("ffff")))).otherwise(F.concat(text, F.unhex(F.lit("ff"))))


def name_of(key: Column) -> Column:
    """The name that key_of() packed."""
    ends = F.when(F.hex(key).endswith("FFFF"), 2).otherwise(1)
    return F.when(F.length(key) == 16, F.lower(F.hex(key))).otherwise(F.decode(F.substring(key, F.lit(1), F.length(key) - ends), "utf-8"))


def packed(signatures: DataFrame, d: int = WIDTH) -> DataFrame:
    """key, built_at, v of the rows with a usable vector: d components, none null or infinite or NaN, not all zero."""
    rows = signatures.filter("md5 is not null").select(key_of(F.col("md5")).alias("md5"), F.col("built_at").cast("timestamp_ntz").alias("built_at"), F.col("vec").cast("array<float>").alias("vec"))
    return rows.mapInArrow(_packer(d), "md5 binary, built_at timestamp_ntz, v binary")


def latest_vectors(signatures: DataFrame, d: int = WIDTH) -> DataFrame:
    """md5 (packed by key_of), v: of each file the usable vector that was built last.

    Rows without md5 have no file. A null built_at is the oldest; of vectors built at the same time the
    greatest packed value wins, so repeats and ties give one defined row. Vectors are packed before the one
    shuffle, in which only one row a file and map task is kept."""
    return packed(signatures, d).groupBy("md5").agg(F.max(F.struct("built_at", "v")).alias("m")).select("md5", "m.v")
