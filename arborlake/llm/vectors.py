"""Integer vectors as packed binaries, the form in which tasks of the vector operators exchange them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Components are held to this size, so that squared distances and inner products of up to 256 components stay exact.
LARGEST = 1 << 27


def usable(vector: str) -> Column:
    """Whether the vector is there and has only finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantized(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double, as array of int; beyond LARGEST it is that."""
    held = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))
    return F.transform(vector, lambda x: F.floor(held(x)).cast("int"))


def lists(col, dims: int):
    """Rows of an Arrow list column of integers as an int64 matrix; shorter rows end in zeros."""
    import numpy as np

    sizes = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
    flat = np.asarray(col.flatten()).astype(np.int64)
    if (sizes == dims).all():
        return flat.reshape(len(col), dims)
    out = np.zeros((len(col), dims), np.int64)
    at = np.repeat(np.arange(len(col)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def pack(matrix):
    """Rows as binaries: two bytes a component if the whole matrix allows it, else four."""
    import numpy as np
    import pyarrow as pa

    small = not matrix.size or (matrix.max() < 1 << 15 and matrix.min() >= -(1 << 15))
    rows = np.ascontiguousarray(matrix, "<i2" if small else "<i4")
    width = rows.shape[1] * rows.itemsize
    ends = pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width or 1, dtype=np.int32)[:len(rows) + 1] if width
                        else np.zeros(len(rows) + 1, np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, pa.py_buffer(rows.tobytes())])


def unpack(col, dims: int):
    """The matrix of packed rows, as int64; rows of both widths may be mixed."""
    import numpy as np

    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    sizes = np.diff(ends)
    out = np.zeros((len(col), dims), np.int64)
    for size, kind in ((2 * dims, "<i2"), (4 * dims, "<i4")):
        rows = np.flatnonzero(sizes == size)
        if len(rows) and dims:
            whole = len(rows) == len(col)
            raw = data[ends[0]:ends[-1]] if whole else data[ends[rows][:, None] + np.arange(size)].ravel()
            out[rows] = np.frombuffer(raw.tobytes(), kind).reshape(len(rows), dims)
    return out
