"""Functions that query texts may name where no built-in expression can say it: dense products on the arrays of a row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructType


def again(nwin: int, w: np.ndarray, pc: np.ndarray, n: np.ndarray) -> tuple[int, int]:
    """Of one song's counts n of pitch class pc in window w: windows with a cosine above 0.95 to one beyond the
    neighbourhood, and places where neighbours stop being alike (cosine 0.5).

    A pitch class of -99 (no pitch) counts in a window's length but equals no other. Only windows with notes are in the matrix."""
    at, row = np.unique(w, return_inverse=True)
    classes, column = np.unique(pc, return_inverse=True)
    x = np.zeros((len(at), len(classes)))
    np.add.at(x, (row, column), n)
    ss = (x * x).sum(1)
    x = x[:, classes > -99]
    dot = x @ x.T
    hit = (1e4 * dot * dot > 9025.0 * ss[:, None] * ss[None, :]) & (at[None, :] - at[:, None] > max(2, nwin // 16))
    i = np.arange(len(at) - 1)
    near = dot[i, i + 1]
    p = at[:-1][(np.diff(at) == 1) & (near > 0) & (4.0 * near * near >= ss[:-1] * ss[1:])]
    ends = np.r_[np.diff(p) > 1, True][: len(p)]
    return int((hit.any(1) | hit.any(0)).sum()), int((ends & (p + 1 <= nwin - 2)).sum())


@arrow_udf(StructType().add("hits", LongType()).add("rises", LongType()))
def windows_again(nwin: pa.Array, counts: pa.Array) -> pa.Array:
    size, flat = counts.value_lengths().to_numpy(), counts.flatten()
    end = size.cumsum()
    w, pc, n = flat.field("w").to_numpy(), flat.field("pc").fill_null(-99).to_numpy(), flat.field("n").to_numpy()
    found = [again(k, w[a:b], pc[a:b], n[a:b]) for k, a, b in zip(nwin.to_pylist(), (end - size).tolist(), end.tolist())]
    return pa.StructArray.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], ["hits", "rises"])


FUNCTIONS = {"windows_again": windows_again}
