"""Sorted number lists as compact bytes."""

from __future__ import annotations


def pack_sorted(numbers) -> bytes:
    """Ascending whole numbers: a gap under 65,535 takes two bytes, any other ten."""
    import numpy as np

    gaps = np.diff(numbers, prepend=0)
    wide = gaps >= 65_535
    return len(gaps).to_bytes(4, "little") + np.minimum(gaps, 65_535).astype("<u2").tobytes() + gaps[wide].astype("<u8").tobytes()


def unpack_sorted(data: bytes):
    import numpy as np

    n = int.from_bytes(data[:4], "little")
    gaps = np.frombuffer(data, "<u2", n, 4).astype(np.int64)
    gaps[gaps == 65_535] = np.frombuffer(data, "<u8", -1, 4 + 2 * n).astype(np.int64)
    return np.cumsum(gaps)
