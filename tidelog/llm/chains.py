"""Encoding chains: text written in one encoding and read in another, forwards and backwards.

A chain is a pair (written, read). Bytes that an encoding leaves undefined are read as the control
character of the same number, as lenient decoders do; going backwards they become that byte again.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

#: What texts may have been written in, and read in.
WRITTEN = ("utf-8", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp737", "cp850", "cp852", "cp857", "cp861", "cp866", "mac_roman", "mac_latin2", "mac_cyrillic", "mac_greek", "mac_turkish", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_9", "cp932", "euc_jp")
READ = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp852", "cp866", "mac_roman", "koi8_r", "iso8859_2", "iso8859_7", "cp932")
MULTIBYTE = frozenset(("utf-8", "cp932", "euc_jp"))
CHAINS = tuple((w, r) for w in WRITTEN for r in READ if w != r)
#: Reading encodings for which a text may have gone through the same chain again.
AGAIN = ("latin-1", "cp1252")
DEPTH = 3


@lru_cache
def _reading(encoding: str) -> tuple[dict[int, str], dict[str, int]]:
    chars = {b: bytes([b]).decode(encoding, "replace") for b in range(256)}
    chars = {b: chr(b) if c == "�" else c for b, c in chars.items()}
    return chars, {c: b for b, c in chars.items()}


def read_bytes(data: bytes, encoding: str) -> str | None:
    if encoding == "cp932":
        try:
            return data.decode("cp932")
        except UnicodeDecodeError:
            return None
    return data.decode("latin-1").translate(_reading(encoding)[0])


def sequence(char: str, read: str) -> int:
    """How many bytes the UTF-8 sequence has whose first byte ``char`` stands for, 0 if it stands for none."""
    b = 0 if read == "cp932" else _reading(read)[1].get(char, 0)
    return 0 if not 0xC2 <= b <= 0xF4 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4


def garble(text: str, chain: tuple[str, str]) -> str | None:
    """``text`` through the chain, or None if the chain cannot carry it."""
    try:
        data = text.encode(chain[0])
    except UnicodeEncodeError:
        return None
    if chain[0] == "cp932" and data.decode("cp932") != text:  # it has several characters for some codes
        return None
    return read_bytes(data, chain[1])


def ungarble(text: str, chain: tuple[str, str]) -> str | None:
    """The strict inverse: None unless every character has a byte and the bytes decode without error."""
    try:
        if chain[1] == "cp932":
            data = text.encode("cp932")
        else:
            table = _reading(chain[1])[1]
            data = bytes([table[c] for c in text])
        return data.decode(chain[0])
    except (KeyError, UnicodeError):
        return None


def inverses(text: str, chain: tuple[str, str]) -> list[str]:
    """Strict inverses of ``text``: once, and for UTF-8 again up to DEPTH times; with and without case changes."""
    out = []
    starts = [text]
    if chain[0] == "utf-8":  # the garbled text may have been set in lower or upper case afterwards
        starts += [s for s in (_cased(text, str.upper), _cased(text, str.lower)) if s != text]
    for now in starts:
        for depth in range(DEPTH if chain[0] == "utf-8" else 1):
            tries = [chain] if depth == 0 else [("utf-8", r) for r in AGAIN]
            now = next((o for o in (ungarble(now, c) for c in tries) if o is not None and o != now), None)
            if now is None:
                break
            out.append(unicodedata.normalize("NFC", now))
    return out


def unwound(text: str, chain: tuple[str, str], depth: int) -> str | None:
    """The strict inverse taken ``depth`` times: by the chain, then by UTF-8 read in a Latin encoding. It is not composed."""
    now: str | None = text
    for d in range(depth):
        tries = [chain] if d == 0 else [("utf-8", r) for r in AGAIN]
        now = next((o for c in tries if (o := ungarble(now, c)) is not None and o != now), None)
        if now is None:
            return None
    return now


def _cased(text: str, change) -> str:
    return "".join(d if len(d := change(c)) == 1 and c > "\x7f" and ord(d) < 256 else c for c in text)


def lossy_forms(text: str) -> list[str]:
    """What is left of ``text`` read in a Latin encoding when control characters or case were dropped after it."""
    out = []
    for read in AGAIN:
        g = garble(text, ("utf-8", read))
        if g is None:
            continue
        bare = "".join(c for c in g if not "\x80" <= c <= "\x9f")
        out += [bare, bare.replace("\xad", ""), g.lower(), bare.lower()]
    return [unicodedata.normalize("NFC", g) for g in dict.fromkeys(out)]


#: The byte order marks of UTF-16 and UTF-8 as the reading encodings show them at the start of a text.
MARKS = tuple(dict.fromkeys(read_bytes(m, r) for m in (b"\xff\xfe", b"\xef\xbb\xbf") for r in READ if r != "cp932"))
MARKS_UTF8 = tuple(m for m in MARKS if len(m) == 3)

#: The chains between encodings of one byte a character, and those with longer sequences.
SINGLE = tuple(c for c in CHAINS if c[0] not in MULTIBYTE and c[1] != "cp932")
LONGER = tuple(c for c in CHAINS if c not in frozenset(SINGLE))


@lru_cache
def _sequences() -> re.Pattern:
    """A first byte of a UTF-8 sequence and a later byte, as any reading encoding shows them, in any case."""
    first, later = set(), set()
    for read in READ:
        if read != "cp932":
            for b, c in _reading(read)[0].items():
                for d in {c, c.upper(), c.lower()}:
                    if len(d) == 1:
                        (first if 0xC2 <= b <= 0xF4 else later if 0x80 <= b < 0xC0 else set()).add(d)
    cls = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]"
    return re.compile(cls(first) + cls(later))


def longer(text: str) -> list[tuple[str, str]]:
    """The chains of LONGER that can have an inverse of ``text`` at all."""
    utf8 = bool(_sequences().search(text))
    pairs = any(a > "\x7f" and b > "\x7f" for a, b in zip(text, text[1:]))
    return [c for c in LONGER if c[1] == "cp932" or (utf8 if c[0] == "utf-8" else pairs if c[0] == "euc_jp" else True)]


class Letters:
    """A sum over the letters of words, and of what each chain of SINGLE makes of them, many words at a time.

    Equal for words of the same letters apart from case, order and the characters ``skip``. Two words of different
    letters have equal sums by chance only; what is found by sums must be compared.
    """

    def __init__(self, skip: str):
        self.skip = frozenset(skip)
        chars = sorted({chr(b) for b in range(128)} | {c for r in READ if r != "cp932" for c in _reading(r)[1]})
        self.at = np.full(0x10000, len(chars), np.uint16)  # the last place stands for characters no chain has
        self.at[[ord(c) for c in chars]] = np.arange(len(chars))
        self.sums = np.zeros((len(SINGLE), len(chars) + 1), np.uint64)
        self.wrong = np.ones((len(SINGLE), len(chars) + 1), np.uint8)
        for k, chain in enumerate(SINGLE):
            for i, c in enumerate(chars):
                o = ungarble(c, chain)
                if o is not None:
                    self.sums[k, i], self.wrong[k, i] = sum(map(self.mixed, o.lower())) % (1 << 64), 0

    def mixed(self, c: str) -> int:
        return 0 if c in self.skip else _mix(ord(c))

    def of(self, word: str) -> int:
        return sum(map(self.mixed, word.lower())) % (1 << 64)

    def inverses(self, words: list[str], known: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, tuple[str, str]]]:
        """(word's place, chain) wherever ``known`` says yes to the sum of the word's inverse by the chain."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
        place = self.at[np.minimum(codes, 0xFFFF)]
        starts = np.cumsum([0, *map(len, words)])[:-1]
        for k, chain in enumerate(SINGLE):
            fits = np.add.reduceat(self.wrong[k][place], starts, dtype=np.int64) == 0
            sums = np.add.reduceat(self.sums[k][place], starts)
            for i in np.flatnonzero(fits & known(sums)).tolist():
                yield i, chain


@lru_cache(1 << 12)
def _mix(n: int) -> int:
    n = (n + 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 % (1 << 64)
    return (n ^ (n >> 31)) * 0x94D049BB133111EB % (1 << 64)


@lru_cache
def letters(skip: str) -> Letters:
    return Letters(skip)
