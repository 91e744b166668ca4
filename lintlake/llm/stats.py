"""Statistics of whole texts, computed for a slice of texts at once."""

from __future__ import annotations

import numpy as np

from lintlake.llm import text as T

WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_FIRST_BYTE = np.ones(256, bool)  # not a continuation byte: one per code point
_FIRST_BYTE[0x80:0xC0] = False

FEATURES = (
    "log_words", "log_lines", "word_length", "words_per_line", "symbols", "pipes", "letters", "upper", "digits", "marks", "ends",
    "repeated", "same_as_before", "distinct", "dup_lines", "short_words",
)


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def distinct_per_text(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    _, at = np.unique(_own(hashes, doc), return_index=True)
    return np.bincount(doc[at], minlength=n)


def _own(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts."""
    return hashes ^ T.mix(doc.astype(np.uint64) + np.uint64(1))


class TextStats:
    """Counts per text of a slice: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``; ``lines`` holds
    (text, key hash, words) of every line with a word, the key being the line trimmed and with A-Z in lower case."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        self.words = words = T.Words(data, offsets)
        self.hashes = words.hashes()
        self.n_words = words.counts().astype(np.int64)
        self.word_chars = per_text(~T.SPACE[data] & _FIRST_BYTE[data], offsets)
        self.n_symbols = per_text(_SYMBOL[data], offsets)
        lines = T.Words(data, offsets, _NEWLINE)
        begin, end = np.searchsorted(words.starts, lines.starts), np.searchsorted(words.starts, lines.ends)
        full = np.flatnonzero(end > begin)
        self.line_doc, begin, end = lines.doc[full], begin[full], end[full]
        raw = T.span_hashes(data, lines.starts[full], lines.ends[full])
        self.n_dup_lines = np.bincount(self.line_doc, minlength=n) - distinct_per_text(raw, self.line_doc, n)
        self.line_hash = T.span_hashes(_LOWER[data], words.starts[begin], words.ends[end - 1]) if len(full) else raw
        self.line_words = end - begin
        at = T.inside_text(words, WINDOW)
        key = _own(T.window_hashes(self.hashes, WINDOW)[at], words.doc[at])
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1] if len(key) else np.zeros(0, bool)
        twice = order[np.append(same, False) | np.append(False, same)] if len(key) else order
        self.n_repeat_words = np.bincount(words.doc[T.covered(len(words), at[twice], WINDOW)], minlength=n)

    def features(self) -> np.ndarray:
        """One row of ``FEATURES`` per text."""
        words, data, off = self.words, self.words.data, self.words.offsets
        n, some = len(off) - 1, np.maximum(self.n_words, 1)
        chars = np.maximum(per_text(_FIRST_BYTE[data], off), 1)
        lines = np.maximum(np.bincount(self.line_doc, minlength=n), 1)
        letters = per_text(_LETTER[data] & _FIRST_BYTE[data], off)
        last = data[words.ends - 1] if len(words) else data
        same = np.zeros(len(words), bool)
        same[1:] = (self.hashes[1:] == self.hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
        marks = per_text((data == 33) | (data == 63), off)
        return np.stack([
            np.log1p(self.n_words), np.log1p(lines), self.word_chars / some, self.n_words / lines, self.n_symbols / chars,
            per_text(data == 124, off) / some, letters / chars, per_text(_UPPER[data], off) / np.maximum(letters, 1),
            per_text(_DIGIT[data], off) / chars, marks / some, np.bincount(words.doc[last == 46], minlength=n) / some,
            self.n_repeat_words / some, np.bincount(words.doc[same], minlength=n) / some,
            distinct_per_text(self.hashes, words.doc, n) / some, self.n_dup_lines / lines,
            np.bincount(words.doc[words.ends - words.starts <= 3], minlength=n) / some,
        ], 1).astype(np.float64)
