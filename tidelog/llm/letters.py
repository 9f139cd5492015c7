"""Letters, digits, white space and small letters as the tokenizers library knows them.

This Python's tables may be older (15.1 of Unicode): what Unicode 16 added to the classes and Unicode 16 and 17 to the
small letters is stated here.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterable

#: Unicode's white space.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: First and last of the letters and numbers that Unicode 16 added.
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: First and last capital that Unicode 16 or 17 added, and the first one's small letter.
NEW_CAPITALS = [(0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]
SMALL = {c: small + c - first for first, last, small in NEW_CAPITALS for c in range(first, last + 1)}


@functools.cache
def letters_and_numbers() -> tuple[frozenset[int], frozenset[int]]:
    kinds = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    every = lambda kind, new: frozenset(c for c, k in enumerate(kinds) if k == kind) | {c for a, z in new for c in range(a, z + 1)}
    return every("L", NEW_LETTERS), every("N", NEW_NUMBERS)


def bracket(codes: Iterable[int]) -> str:
    """Code points as the inside of a pattern's brackets."""
    out: list[list[int]] = []
    for c in sorted(codes):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in out)

#: Combining marks (and one letter with its second half) that came after Unicode 9, whose tables the tokenizers library composes by.
NEWER_MARKS = (
    "\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c"
    "\U00010d24-\U00010d27\U00010eab-\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b\U0001145e\U00011839-\U0001183a"
    "\U00011930\U00011938\U0001193d-\U0001193e\U00011943\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44-\U00011d45\U00011d97\U00011f41-\U00011f42"
    "\U00016ff0-\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef"
)
NEWER = re.compile(f"([{NEWER_MARKS}])")
