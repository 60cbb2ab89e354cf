"""Whole-text statistics that the quality operators share (exact, one pass per text)."""

from __future__ import annotations

from collections import Counter
from operator import eq

SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
WINDOW = 5


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in some 5-word window found twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    seen = Counter(windows)
    if len(seen) == n:
        return 0
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + WINDOW - max(i, end)
            end = i + WINDOW
    return covered


def dup_lines(raw: bytes) -> tuple[int, int]:
    """Lines that hold a word, and how many of them equal an earlier one."""
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return len(lines), len(lines) - len(set(lines))


def text_stats(text: str | None) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    upper, letters, digits, bangs, adjacent_equal, distinct) of a whole text;
    all zero for null. Words are runs of bytes other than space and tab to CR."""
    if not text:
        return (0,) * 12
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n_lines, n_dup = dup_lines(raw)
    n = len(raw)
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\v\f\r")),
        n - len(raw.translate(None, SYMBOLS)),
        n_lines,
        n_dup,
        repeat_words(words),
        n - len(raw.translate(None, _UPPER)),
        n - len(raw.translate(None, _LETTERS)),
        n - len(raw.translate(None, _DIGITS)),
        raw.count(b"!"),
        sum(map(eq, words, words[1:])),
        len(set(words)),
    )
