"""Words of many texts at once, as 64-bit hashes in numpy arrays: code points are folded by tables, words are hashed by powers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np

_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
#: Letters of other scripts that look like Latin ones.
_LOOK = str.maketrans("аеорсухіјѕԁһԛԝɡνοικαρτ", "aeopcyxijsdhqwgvoikapt")
#: First and last code points of scripts written without spaces (Thai and Lao, Myanmar, Khmer, kana, Han).
DENSE = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
_POINTS = 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Characters that are hashed at a time.
SLICE = 150_000


def _fold(ch: str) -> str:
    """What a character is in a word: its base letters without case; nothing for marks of Latin letters and invisible
    characters; a space for what is no part of a word."""
    if 0xD800 <= ord(ch) < 0xE000:
        return " "
    if "̀" <= ch <= "ͯ" or _INVISIBLE.match(ch):
        return ""
    s = "".join(x for x in unicodedata.normalize("NFKD", ch) if not "̀" <= x <= "ͯ").casefold().translate(_LOOK)
    return "".join(x if x.isalnum() or unicodedata.category(x)[0] == "M" else " " for x in s)


class Lexer:
    """Folding tables by code point, filled as characters are met."""

    def __init__(self) -> None:
        self.size = np.full(_POINTS, 255, dtype=np.uint8)  # 255: not met yet
        self.place = np.zeros(_POINTS, dtype=np.int32)
        self.flat = np.zeros(1024, dtype=np.uint32)
        self.used = 0
        #: of folded characters: the number that is hashed (0 outside words), and 1 word, 2 script without spaces, else 0
        self.value = np.zeros(_POINTS, dtype=np.uint64)
        self.kind = np.zeros(_POINTS, dtype=np.uint8)
        self._grow(2 * SLICE)
        self._meet(np.arange(128))
        base = np.array([self.flat[self.place[c]] if self.size[c] else 32 for c in range(128)])
        self.ascii_value, self.ascii_kind = self.value[base], self.kind[base]

    def _grow(self, n: int) -> None:
        self.powers = np.cumprod(np.full(n, _BASE, dtype=np.uint64))
        self.inverse = np.cumprod(np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64))

    def _meet(self, points: np.ndarray) -> None:
        for c in points.tolist():
            s = [ord(x) for x in _fold(chr(c))]
            if self.used + len(s) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(s)] = s
            self.size[c], self.place[c] = len(s), self.used
            self.used += len(s)
            for x in s:
                self.kind[x] = 0 if x == 32 else 2 if any(a <= x <= b for a, b in DENSE) else 1
                v = ((x + 1) * 0xC2B2AE3D27D4EB4F) % (1 << 64)
                self.value[x] = v ^ (v >> 29) if self.kind[x] == 1 else 0

    def hashes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of the texts in order, and the number of words of each text.

        A word is a run of letters, digits and marks without case, accents and special forms of letters. In scripts
        without spaces every two neighbouring characters are a word, and a character alone where it has no neighbour.
        """
        joined = " " + " ".join(texts) + " "
        ends = np.cumsum([len(t) + 1 for t in texts])
        cp = None
        if joined.isascii():
            raw = np.frombuffer(joined.encode(), dtype=np.uint8)
            value, kind = self.ascii_value[raw], self.ascii_kind[raw]
        else:
            raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            size = self.size[raw]
            if size.max() == 255:
                self._meet(np.unique(raw[size == 255]))
                size = self.size[raw]
            if size.min() == 1 == size.max():
                cp = self.flat[self.place[raw]]
            else:
                upto = np.cumsum(size, dtype=np.int64)
                ends = upto[ends] - 1
                cp = self.flat[np.repeat(self.place[raw] - (upto - size), size) + np.arange(upto[-1])]
            value, kind = self.value[cp], self.kind[cp]
        word = kind == 1
        starts = np.flatnonzero(word[1:] > word[:-1]) + 1
        out = np.zeros(0, dtype=np.uint64)
        if len(starts):
            if len(value) > len(self.powers):
                self._grow(2 * len(value))
            out = np.add.reduceat(value * self.powers[: len(value)], starts) * self.inverse[starts]
        dense = np.flatnonzero(kind == 2) if cp is not None else starts[:0]
        if len(dense):
            near = np.diff(dense) == 1
            follows, has_next = np.concatenate([[False], near]), np.concatenate([near, [False]])
            c = cp[dense].astype(np.uint64) + np.uint64(1)
            pair = (c * _BASE) ^ (np.where(has_next, np.append(c[1:], np.uint64(0)), np.uint64(0)) * np.uint64(0xC2B2AE3D27D4EB4F))
            keep = has_next | ~follows
            place = np.concatenate([starts, dense[keep]])
            order = np.argsort(place, kind="stable")
            starts, out = place[order], np.concatenate([out, pair[keep]])[order]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        return (out >> np.uint64(1)).astype(np.int64), np.diff(np.searchsorted(starts, ends), prepend=0)


_lexer: Lexer | None = None


def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    global _lexer
    if _lexer is None:
        _lexer = Lexer()
    return _lexer.hashes(texts)


def slices(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, words and numbers of words, for texts of about SLICE characters at a time, plain ASCII texts apart from
    others; texts without words are left out. A text is never cut."""
    for plain in (True, False):
        rows: list[int] = []
        n = 0
        for k, t in enumerate(texts):
            if t and t.isascii() is plain:
                rows.append(k)
                n += len(t)
                if n >= SLICE:
                    yield from _slice(texts, rows)
                    rows, n = [], 0
        if rows:
            yield from _slice(texts, rows)


def _slice(texts: list[str | None], rows: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    found, counts = hashes([texts[k] for k in rows])
    some = counts > 0
    if some.any():
        yield np.array(rows)[some], found, counts[some]
