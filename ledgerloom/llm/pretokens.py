"""Splits text by a tokenizer's pattern; most texts take a quick path."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex


def _latin_pattern(pattern: str) -> re.Pattern:
    """The pattern for texts whose code points are all below 256, with its classes spelled out for the re module."""
    chars = [chr(c) for c in range(256)]
    classes = {
        name: "".join(f"\\x{ord(c):02x}" for c in chars if regex.fullmatch(name, c))
        for name in (r"\p{L}", r"\p{N}", r"\s")
    }
    out, inside, at = [], False, 0
    while at < len(pattern):
        name = next((n for n in classes if pattern.startswith(n, at)), None)
        if name:
            out.append(classes[name] if inside else f"[{classes[name]}]")
            at += len(name)
        elif pattern.startswith(r"\S", at):
            out.append(f"[^{classes[chr(92) + 's']}]")
            at += 2
        else:
            inside = pattern[at] == "[" or (inside and pattern[at] != "]")
            out.append(pattern[at])
            at += 1
    return re.compile("".join(out))


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that gives all matches of the pattern, in order.

    The pattern may use \\p{L}, \\p{N}, \\s and \\S. Texts with only Latin-1 characters are split by the
    re module, all others by the regex module; both give the same pieces.
    """
    quick, full = _latin_pattern(pattern).findall, regex.compile(pattern).findall

    def split(text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return full(text)
        return quick(text)

    return split


#: Classes of characters in byte_level_cuts.
OTHER, LETTER, DIGIT, WHITE = 0, 1, 2, 3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    every, out = "".join(map(chr, range(0x110000))), np.zeros(0x110000, np.uint8)
    for name, value in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", WHITE)):
        for m in regex.finditer(name, every):
            out[m.start() : m.end()] = value
    return out


def _class_of_bytes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 belongs to."""
    classes = _classes()
    out = classes[:256].copy()[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead]
        length = 2 + (first >= 0xE0).astype(np.int8) + (first >= 0xF0)
        point = (first & (0x7F >> length)).astype(np.uint32)
        for k in range(1, 4):
            more = length > k
            point[more] = point[more] << 6 | (data[lead[more] + k] & 0x3F)
        for k in range(4):
            more = length > k
            out[lead[more] + k] = classes[point[more]]
    return out


def byte_level_cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Offsets at which the byte-level pattern's matches begin, in texts that stand in a row.

    data has the UTF-8 bytes of the texts, starts the offsets of those that aren't empty. The pattern is
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+: a match ends where the class of characters changes, but a
    space before other characters belongs to them, the last white character before others stands alone, and a
    match that would begin with an apostrophe may be a contraction.
    """
    if not len(data):
        return np.empty(0, np.int64)
    kind, begins = _class_of_bytes(data), np.zeros(len(data) + 1, bool)
    begins[starts] = begins[-1] = True
    cut = begins.copy()
    cut[1:-1] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(cut[1:-1] & (kind[:-1] == WHITE) & ~begins[1:-1]) + 1  # others that follow white characters
    last = after - 1
    for _ in range(3):
        last -= (data[last] & 0xC0) == 0x80
    cut[last] = True
    cut[after] = data[last] != 0x20
    quote = np.flatnonzero((data == 0x27) & cut[:-1])
    quote = quote[~begins[quote + 1]]
    one = quote[np.isin(data[quote + 1], np.frombuffer(b"stmd", np.uint8))]
    two = quote[~begins[quote + 2]]
    pair = data[two + 1].astype(np.uint16) << 8 | data[two + 2]
    two = two[np.isin(pair, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])]
    for found, length in ((one, 1), (two, 2)):
        cut[found + 1] = False
        cut[found + 1 + length] = True
    return np.flatnonzero(cut[:-1])
