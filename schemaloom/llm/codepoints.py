"""Arrow text as numpy code points and back, a whole batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def to_codepoints(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(code points uint32, row offsets)``; a null row has none. Ill-formed bytes become U+FFFD."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    raw = pc.fill_null(pc.cast(text, pa.large_string()), "")
    _, offsets, data = raw.buffers()
    begin = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    body = b"" if data is None else data.to_pybytes()[begin[0] : begin[-1]]
    try:
        points = np.frombuffer(body.decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        rows = [body[a - begin[0] : b - begin[0]].decode("utf-8", "replace") for a, b in zip(begin[:-1], begin[1:])]
        return np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    leads = (np.frombuffer(body, np.uint8) & 0xC0) != 0x80
    counted = np.concatenate([[0], np.cumsum(leads)])
    return points, counted[begin - begin[0]]


def to_text(points: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The inverse of ``to_codepoints``; ``valid`` marks the rows that aren't null."""
    body = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(width)])[offsets].astype(np.int64)
    mask = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    rows = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(body), mask)
    return rows.cast(pa.string())
