"""Vectorised text kernels: whole Arrow batches of strings as flat numpy arrays, no per-word Python.

A *word* is a maximal run of Unicode letters or digits, lower-cased; positions count code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MULT = np.uint64(0x9E3779B97F4A7C15)
MULT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHUNK_CHARS = 1 << 19
_BMP = 1 << 16
_tables: dict[str, np.ndarray] = {}


def _bmp(kind: str) -> np.ndarray:
    """Look-up tables over the basic plane, made once in each worker."""
    if kind not in _tables:
        chars = [chr(i) for i in range(_BMP)]
        if kind == "lower":
            low = [c.lower() for c in chars]
            _tables[kind] = np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(low)], np.uint32)
        else:
            test = {"alnum": str.isalnum, "alpha": str.isalpha, "space": str.isspace}[kind]
            _tables[kind] = np.array([test(c) for c in chars])
    return _tables[kind]


def classify(points: np.ndarray, kind: str) -> np.ndarray:
    """Per code point: its lower case, or whether it is alnum, alpha or space."""
    out = _bmp(kind)[np.minimum(points, _BMP - 1)]
    high = points >= _BMP
    if high.any():
        values, inverse = np.unique(points[high], return_inverse=True)
        if kind == "lower":
            each = [ord(x) if len(x := chr(v).lower()) == 1 else v for v in values]
        else:
            each = [{"alnum": str.isalnum, "alpha": str.isalpha, "space": str.isspace}[kind](chr(v)) for v in values]
        out = out.copy()
        out[high] = np.array(each)[inverse]
    return out


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply); another salt gives an independent hash."""
    x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inv" if inverse else "pow"
    if len(_powers.get(key, ())) < n:
        p = np.full(max(n, CHUNK_CHARS), MULT_INV if inverse else MULT, np.uint64)
        p[0] = 1
        _powers[key] = np.cumprod(p)
    return _powers[key][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[i:j] * B**index, the base of every rolling hash here."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def rolling_hash(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of each run of ``width`` successive values (64 bit, finalised)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = prefix_hash(values)
    return mix((p[width:] - p[:n]) * powers(n, inverse=True))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` successive values in linear time (block prefix and suffix minima)."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    pad = -len(values) % width
    full = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and the start of each text (with the end of the last); NULL counts as empty."""
    texts = [t or "" for t in texts]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), starts


def runs(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross a text border: begin, end, and how many began before each border."""
    first = np.zeros(len(inside) + 1, bool)
    first[starts] = True
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    begins = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return begins, ends, np.searchsorted(begins, starts)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every word in order, and the offset of each text's first one."""
    points, starts = code_points(texts)
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    begins, ends, offsets = runs(classify(points, "alnum"), starts)
    p = prefix_hash(mix(classify(points, "lower").astype(np.uint64)))
    hashed = mix((p[ends] - p[begins]) * powers(len(points), inverse=True)[begins])
    return hashed, offsets


def distinct_per_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row and the new offsets."""
    if not len(values):
        return values, offsets
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[keep], rows[keep]
    return values, np.searchsorted(rows, np.arange(len(offsets)))


def rows_of(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of some of the rows."""
    n = np.diff(offsets)[rows]
    ends = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(n, out=ends[1:])
    return values[np.repeat(offsets[rows] - ends[:-1], n) + np.arange(ends[-1])], ends


def set_keys(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each row's set of values, whatever their order: two sums of independent hashes."""

    def total(salt: int) -> np.ndarray:
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values, salt), out=sums[1:])
        return mix(sums[offsets[1:]] - sums[offsets[:-1]], salt)

    return total(11), total(12)


def as_long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without NULLs inside; a NULL list counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = np.zeros(len(column) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return column.flatten().to_numpy(zero_copy_only=False), offsets


def chunks(batches: Iterator[pa.RecordBatch], *columns: str, max_chars: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the named string columns together hold about ``max_chars`` bytes at most;
    a longer single row comes alone and whole."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = sum(pc.fill_null(pc.binary_length(batch[c]), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            limit = (ends[at - 1] if at else 0) + max_chars
            to = max(at + 1, int(np.searchsorted(ends, limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
