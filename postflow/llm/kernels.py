"""Vectorised byte and word kernels shared by the corpus operators.

Everything here works on the raw UTF-8 buffer of an Arrow string column, so a batch of documents is handled by a few numpy calls.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK = 1 << 16
_MUL = U64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser, so that the order of hashed keys says nothing about their text."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


with np.errstate(over="ignore"):
    BYTE = mix64((np.arange(1, 257, dtype=U64)) * _MUL)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
WORD_BYTE = np.where(SPACE, U64(0), BYTE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[U64(1), np.full(max(n - 1, 0), _MUL)], dtype=U64)[:n]


_POW = powers(4096)


def segment_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """A 64-bit hash of each segment [start, end) of the buffer, a bounded number of bytes at a time."""
    out = np.zeros(len(starts), U64)
    i, lens = 0, ends - starts
    upto = np.cumsum(lens)
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] - lens[i] + 16 * CHUNK, "right")))
            ln = lens[i:j]
            total = np.cumsum(ln) - ln
            rel = np.arange(int(ln.sum())) - np.repeat(total, ln)
            if len(rel):
                pw = _POW if ln.max() <= len(_POW) else powers(int(ln.max()))
                vals = table[buf[rel + np.repeat(starts[i:j], ln)]] * pw[rel]
                some = ln > 0
                out[i:j][some] = np.add.reduceat(vals, total[some])
            i = j
        return mix64(out + lens.astype(U64) * _MUL)


def words(buf: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and hashes of the words [^\\x20\\x09-\\x0D]+; words never cross rows."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U64)
    is_word = ~SPACE[buf]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    heads = offs[:-1][offs[:-1] < offs[-1]]
    first[heads] = is_word[heads]
    last = is_word.copy()
    last[:-1] &= first[1:] | ~is_word[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    src = LOWER[buf] if lower else buf
    return starts, ends, np.searchsorted(offs, starts, "right") - 1, segment_hash(src, starts, ends)


def spelled(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs of bytes inside (whole characters) as strings, with the row, start and end of each; they never cross rows."""
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    heads = offs[:-1][offs[:-1] < offs[-1]]
    head[heads] = inside[heads]
    tail[:-1] &= head[1:] | ~inside[1:]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    cut = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    text = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(cut), pa.py_buffer(buf[inside])])
    return text, np.searchsorted(offs, starts, "right") - 1, starts, ends


def shingles(word_hash: np.ndarray, word_row: np.ndarray, size: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) of the shingles of `size` words, sorted; a shorter row has its whole sequence as one shingle."""
    counts = np.bincount(word_row, minlength=n_rows)
    with np.errstate(over="ignore"):
        acc = np.zeros(max(len(word_hash) - size + 1, 0), U64)
        for k in range(size):
            acc = acc * _MUL + word_hash[k : k + len(acc)]
        row = word_row[: len(acc)]
        whole = row == word_row[size - 1 : size - 1 + len(acc)]
        acc, row = mix64(acc[whole]), row[whole]
        begin = np.cumsum(counts) - counts
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            own = np.zeros(len(short), U64)
            for k in range(size - 1):
                on = counts[short] > k
                own[on] = own[on] * _MUL + word_hash[begin[short[on]] + k]
            acc, row = np.r_[acc, mix64(own + counts[short].astype(U64))], np.r_[row, short]
    order = np.lexsort((acc, row))
    acc, row = acc[order], row[order]
    if len(acc):
        new = np.r_[True, (acc[1:] != acc[:-1]) | (row[1:] != row[:-1])]
        acc, row = acc[new], row[new]
    return row, acc


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated aranges: start, start + 1, ... for each pair."""
    total = np.cumsum(lens) - lens
    return np.arange(int(lens.sum())) - np.repeat(total, lens) + np.repeat(starts, lens)


def released() -> None:
    """Gives back what Arrow and malloc hold unused. Spark's workers live from stage to stage, and each would keep the most that it ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Parts of a batch whose texts stay under about `limit` bytes, one row at least; memory that is not used goes before and after them."""
    released()
    offs = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        base = offs[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(offs, base + limit, "right")))
        yield batch.slice(i, j - i)
        i = j
    released()


def per_row(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are set in each [start, end)."""
    c = np.zeros(len(flags) + 1, np.int32 if len(flags) < 1 << 31 else np.int64)
    np.cumsum(flags, dtype=c.dtype, out=c[1:])
    return (c[ends] - c[starts]).astype(np.int64)


_ASCII = np.arange(256)
STOP = np.isin(_ASCII, np.frombuffer(b".!?", np.uint8))
INNER = (_ASCII >= 128) | ((_ASCII >= 48) & (_ASCII <= 57)) | ((_ASCII >= 65) & (_ASCII <= 90)) | ((_ASCII >= 97) & (_ASCII <= 122))


def sentence_breaks(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each word, whether its sentence ends with it: it ends in . ! or ?, or a line or the row ends after it."""
    if not len(ends):
        return np.zeros(0, bool)
    lines = per_row(buf == 10, ends, np.r_[starts[1:], ends[-1]])
    return STOP[buf[ends - 1]] | (lines > 0) | np.r_[row[1:] != row[:-1], True]


def cores(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words without the ASCII punctuation marks at either end; of a word of marks alone, its middle byte is left."""
    inner = np.flatnonzero(INNER[buf])
    before, after = np.searchsorted(inner, starts), np.searchsorted(inner, ends)
    some = before < after
    a = starts + (ends - starts) // 2
    b = a + 1
    a[some], b[some] = inner[before[some]], inner[after[some] - 1] + 1
    return a, b


def chain_hash(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A hash of each run of values [start, start + len); runs have a value at least and do not overlap."""
    if not len(starts):
        return np.zeros(0, U64)
    at = ranges(starts, lens)
    first = np.cumsum(lens) - lens
    rel = np.arange(len(at)) - np.repeat(first, lens)
    pw = _POW if lens.max() <= len(_POW) else powers(int(lens.max()))
    with np.errstate(over="ignore"):
        return mix64(np.add.reduceat(values[at] * pw[rel], first) + lens.astype(U64))
