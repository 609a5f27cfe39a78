"""Whole batches of texts as flat numpy arrays: words, lines and rolling hashes without a loop per word.

All functions take the bytes of several texts end to end (`buf`, uint8) and the offsets between them.
Hashes are 64 bits of a polynomial over the bytes, finished by a bit mixer; equal content gives equal
hashes wherever it stands, and two different contents of one comparison meet with odds of 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = 0xD6E8FEB86659FD93
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_POWERS: dict = {}


def mix(x):
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n):
    """BASE**i and BASE**-i for i < n (mod 2**64); grown by doubling and kept by the worker."""
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        for name, base in (("p", BASE), ("q", BASE_INVERSE)):
            out, step, k = np.ones(size, np.uint64), base, 1
            while k < size:
                out[k:2 * k] = out[:k] * np.uint64(step)
                step, k = step * step % (1 << 64), 2 * k
            _POWERS[name] = out
    return _POWERS["p"][:n], _POWERS["q"][:n]


def table(members):
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


def pieces(column, limit=1 << 19):
    """Cut an Arrow string column into (first row, bytes, offsets) of about `limit` bytes; a text is never cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), row + 4096, len(column))
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def lower(buf):
    """A-Z to a-z, other bytes as they are."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out[buf]


def prefix_sums(buf):
    """Running polynomial sums: the hash of buf[a:b] follows from two of them, see `spans`."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf) + 1)[0][:len(buf)], out=out[1:])
    return out


def spans(sums, starts, ends):
    """Hashes of the spans [starts, ends) of the text behind `prefix_sums`."""
    at_zero = (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]
    return mix(at_zero + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words(buf, offsets):
    """Starts, ends and text number of all words `[^\\x20\\x09-\\x0D]+`; a word ends where its text ends."""
    n = len(buf)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    space = table(SPACES)[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = ~space & edge[:n]
    starts[1:] |= ~space[1:] & space[:-1]
    ends = ~space & edge[1:]
    ends[:-1] |= ~space[:-1] & space[1:]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def grams(hashes, text_no, k):
    """Hashes of all runs of k words inside one text, and where they start."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[j:j + n]
    at = np.flatnonzero(text_no[:n] == text_no[k - 1:])
    return mix(out[at]), at


def per_text(values, text_no, n):
    """Sums of `values` by text."""
    return np.bincount(text_no, weights=values, minlength=n)


def grouped(keys):
    """Order that sorts `keys`, and the number of the group of equal keys at each place of that order."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    return order, np.cumsum(new) - 1


def in_text(hashes, text_no):
    """Keys that are equal only for equal hashes of the same text."""
    return mix(hashes + text_no.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
