"""Counts of a whole text that the quality operators share."""

from __future__ import annotations

import numpy as np

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: ASCII white space, U+0009 to U+000D and the blank.
SPACE = "\t\n\x0b\x0c\r "
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_letters", "n_bangs", "n_digits"]


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of ``NAMES``; all zero for null and empty texts."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = [seen.setdefault(w, len(seen)) for w in words]
    lines, n_lines, n_dup = set(), 0, 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            n_lines += 1
            if line in lines:
                n_dup += 1
            else:
                lines.add(line)
    return (
        len(words), len(text) - sum(text.count(c) for c in SPACE), sum(text.count(c) for c in SYMBOLS), n_dup, repeat_words(ids),
        n_lines, len(seen), len(raw) - len(raw.translate(None, UPPER)), len(raw) - len(raw.translate(None, LETTERS)), text.count("!"),
        len(raw) - len(raw.translate(None, b"0123456789")),
    )


def repeat_words(ids: list[int], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more.

    Windows are compared exactly: doubling joins two equal halves to a new number for each distinct pair.
    """
    n = len(ids)
    if n <= window or len(set(ids)) == n:
        return 0
    code, width = np.asarray(ids, dtype=np.int64), 1
    while width < window:
        step = min(width, window - width)
        pair = code[:-step] * (int(code.max()) + 1) + code[step:] if width == step else None
        if pair is None:
            raise ValueError("the window must be a power of two")
        _, code = np.unique(pair, return_inverse=True)
        width += step
    again = np.bincount(code)[code] > 1
    if not again.any():
        return 0
    change = np.zeros(n + 1, dtype=np.int64)
    at = np.nonzero(again)[0]
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return int((np.cumsum(change)[:n] > 0).sum())
