"""Folding of dirty text to plain comparable letters."""

from __future__ import annotations

import re
import unicodedata

#: Letters of other scripts that look like Latin ones, and the Latin ones.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁвкмнтзАЕОРСУХІЈЅВКМНТαεορυινκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxijsdbkmhtзAEOPCYXIJSBKMHTaeopuivkABEZHIKMNOPTYX",
)
#: Invisible characters that split words without showing.
INVISIBLE = re.compile("[­​‌‍‎‏⁠﻿᠎]")
_BROKEN = re.compile("[Ãã](.)")
_UMLAUT_BYTES = {"-": 0xAD}


def _repair_pair(m: re.Match) -> str:
    tail = m.group(1)
    try:
        byte = _UMLAUT_BYTES.get(tail) or tail.encode("cp1252")[0]
    except UnicodeEncodeError:
        byte = ord(tail) if ord(tail) < 256 else 0
    return bytes([0xC3, byte]).decode("utf-8") if 0x80 <= byte <= 0xBF else m.group(0)


def repair_encoding(text: str) -> str:
    """Undo UTF-8 that was read as a single-byte code page, also where a part was changed since."""
    return _BROKEN.sub(_repair_pair, text)


def fold(text: str) -> str:
    """Lower-case Latin letters without accents, look-alikes, invisible characters or encoding damage."""
    s = INVISIBLE.sub("", repair_encoding(text))
    s = unicodedata.normalize("NFKD", s.translate(LOOKALIKES))
    return "".join(c for c in s if not unicodedata.combining(c)).replace("ß", "ss").lower()


def damerau(a: str, b: str, most: int = 99) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from a to b; most + 1 where it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    last2: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, last2[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        last2, last = last, row
    return last[-1]


def is_short_form(word: str, full: str) -> bool:
    """Whether word can stand for full: equal, a slip of it, its beginning, or its consonants in order.

    A skeleton keeps the first letter and leaves out inner vowels; it may end in
    the full word's last `o`.  Pieces of a longer name do not pass for one.
    """
    if word == full or (len(word) >= 4 and damerau(word, full, 2) <= (1 if len(full) < 7 else 2)):
        return True
    if not word or len(word) > 6 or word[0] != full[0]:
        return False
    if full.startswith(word):
        return True
    it = iter(full)
    vowels = set("aeiou")
    end_ok = word[-1] not in vowels or word[-1] == full[-1] == "o"
    return all(c in it for c in word) and end_ok and not vowels & set(word[1:-1])
