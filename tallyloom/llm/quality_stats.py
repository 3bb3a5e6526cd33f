"""Counts per text that quality rules and classifiers share."""

from __future__ import annotations

import numpy as np

from tallyloom.llm.textkit import Hasher, Words, keyed, ngrams, per_text

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
LETTER[128:] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?:;"]] = True

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct_words", "n_bangs", "n_stops", "n_digits")


def repeats(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s), bool)
    if len(s):
        equal = s[1:] == s[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    out = np.zeros(len(s), bool)
    out[order] = same
    return out


def text_counts(data: np.ndarray, off: np.ndarray, words: Words | None = None, hasher: Hasher | None = None) -> dict[str, np.ndarray]:
    """NAMES, one long per text.

    Words are ``[^\\x20\\x09-\\x0D]+``; word_chars counts code points in words;
    n_dup_lines counts lines (split at newline, with a word) that equal an
    earlier one; n_repeat_words counts words in three-word windows that occur
    twice or more in the text, the first occurrence included.
    """
    words = words or Words(data, off)
    hasher = hasher or Hasher(data)
    n = len(off) - 1
    out = {"n_words": words.counts.astype(np.int64)}
    out["word_chars"] = per_text(words.inside & ((data & 0xC0) != 0x80), off)
    for name, flags in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_letters", LETTER), ("n_stops", STOP)):
        out[name] = per_text(flags[data], off)
    out["n_bangs"] = per_text(data == 33, off)
    out["n_digits"] = per_text((data >= 48) & (data <= 57), off)

    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([off[:-1], breaks + 1])
    ends = np.concatenate([breaks, off[1:]])
    starts.sort()
    ends.sort()
    # An empty text has one empty line; texts share boundaries, so line k starts and ends in the same text.
    filled = np.searchsorted(words.starts, starts) < np.searchsorted(words.starts, ends)
    s, e = starts[filled], ends[filled]
    owner = np.searchsorted(off[1:], s, "right")
    _, first = np.unique(keyed(hasher.spans(s, e), owner), return_index=True)
    lines = np.bincount(owner, minlength=n)
    out["n_lines"] = lines
    out["n_dup_lines"] = lines - np.bincount(owner[first], minlength=n)

    hashed = hasher.spans(words.starts, words.ends)
    owner = words.owner()
    out["n_distinct_words"] = np.bincount(owner[np.unique(keyed(hashed, owner), return_index=True)[1]], minlength=n) if len(owner) else np.zeros(n, np.int64)
    total = len(hashed)
    covered = np.zeros(total + 2, bool)
    if total > 2:
        at = np.flatnonzero(owner[2:] == owner[:-2])
        hit = at[repeats(keyed(ngrams(hashed, 3)[at], owner[at]))]
        covered[hit] = covered[hit + 1] = covered[hit + 2] = True
    out["n_repeat_words"] = per_text(covered[:total], words.first)
    return out
