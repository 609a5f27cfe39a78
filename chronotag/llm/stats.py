"""Statistics of whole texts that the quality operators share, in Arrow batches."""

from __future__ import annotations

import numpy as np

from chronotag.llm import arrays as A

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("log_words", "word_length", "word_length_spread", "upper", "digit", "symbol", "punctuation", "exclaim", "non_ascii", "distinct_words",
          "top_word", "repeated_words", "dup_lines", "line_words", "ended_lines", "newlines")


def measure(buf, offsets):
    """(COUNTS as int64, RATIOS as float64) of each text, one row per text."""
    n, size = len(offsets) - 1, len(buf)
    starts, ends, no = A.words(buf, offsets)
    n_words = np.bincount(no, minlength=n)
    counts, ratios = np.zeros((n, len(COUNTS)), np.int64), np.zeros((n, len(RATIOS)))
    if size == 0 or len(starts) == 0:
        byte_no = np.repeat(np.arange(n), np.diff(offsets))
        counts[:, 2] = A.per_text(A.table(SYMBOLS)[buf], byte_no, n)
        return counts, ratios
    sums = A.prefix_sums(buf)
    hashes = A.spans(sums, starts, ends)

    def total(mask):
        """Bytes of a kind by text."""
        running = np.concatenate([[0], np.cumsum(mask)])
        return running[offsets[1:]] - running[offsets[:-1]]

    leads = (buf & 0xC0) != 0x80
    solid = leads & ~A.table(A.SPACES)[buf]
    chars = np.concatenate([[0], np.cumsum(solid)])
    lengths = (chars[ends] - chars[starts]).astype(float)
    n_chars, symbols = total(solid), total(A.table(SYMBOLS)[buf])

    # lines: a text's lines lie between its newlines; a line counts when it has a word
    breaks = np.flatnonzero(buf == 10)
    first = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    inner = first[first < size]
    stops = np.minimum(offsets[np.searchsorted(offsets, inner, side="right")],
                       np.concatenate([breaks, [size]])[np.searchsorted(breaks, inner, side="left")])
    in_words = np.searchsorted(starts, stops) - np.searchsorted(starts, inner)
    kept = in_words > 0
    inner, stops, in_words = inner[kept], stops[kept], in_words[kept]
    line_no = np.searchsorted(offsets, inner, side="right") - 1
    order, group = A.grouped(A.in_text(A.spans(sums, inner, stops), line_no))
    again = np.zeros(len(inner), bool)
    again[order[1:]] = group[1:] == group[:-1]
    lines, dups = np.bincount(line_no, minlength=n), A.per_text(again, line_no, n)
    last = starts[np.searchsorted(starts, stops) - 1]
    ended = A.table(b".!?:;\"')]")[buf[ends[np.searchsorted(starts, last)] - 1]]

    # words of windows that occur again in the same text
    windows, at = A.grams(hashes, no, WINDOW)
    order, group = A.grouped(A.in_text(windows, no[at]))
    twice = at[order][np.bincount(group)[group] > 1] if len(group) else at
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    repeated = A.per_text(np.cumsum(cover[:-1]) > 0, no, n)

    order, group = A.grouped(A.in_text(hashes, no))
    uses, owner = np.bincount(group), np.zeros(group[-1] + 1, np.int64)
    owner[group] = no[order]
    top = np.zeros(n)
    np.maximum.at(top, owner, uses)

    counts[:] = np.stack([n_words, n_chars, symbols, dups, repeated], 1)
    w, c, ln = np.maximum(n_words, 1), np.maximum(n_chars, 1), np.maximum(lines, 1)
    mean = A.per_text(lengths, no, n) / w
    ratios[:] = np.stack([
        np.log1p(n_words), np.log1p(mean), np.sqrt(np.maximum(A.per_text(lengths ** 2, no, n) / w - mean ** 2, 0)),
        total((buf >= 65) & (buf <= 90)) / c, total((buf >= 48) & (buf <= 57)) / c, np.sqrt(symbols / c),
        np.sqrt(total(A.table(b".,;:?\"'()-")[buf]) / c), np.sqrt(total(buf == 33) / c), total(leads & (buf >= 0x80)) / c,
        np.bincount(owner, minlength=n) / w, np.sqrt(top / w), np.sqrt(repeated / w), np.sqrt(dups / ln), np.log1p(n_words / ln),
        A.per_text(ended, line_no, n) / ln, np.sqrt(total(buf == 10) / c)], 1)
    ratios[n_words == 0] = 0
    return counts, ratios


def batches(column):
    """`measure` over an Arrow column of texts, put together again."""
    parts = [measure(buf, offsets) for _, buf, offsets in A.pieces(column)]
    if not parts:
        return np.zeros((0, len(COUNTS)), np.int64), np.zeros((0, len(RATIOS)))
    return tuple(np.concatenate(x) for x in zip(*parts))
