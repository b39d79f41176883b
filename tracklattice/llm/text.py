"""Folding of dirty text to plain letters."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

# fixed values: letters of other scripts that look like Latin ones
LOOKALIKES = str.maketrans(
    "аеорсухіјѕһԁԛԝ" "АВЕКМНОРСТУХІЈЅԌ" "οανικτυρ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxijshdqw" "ABEKMHOPCTYXIJSG" "oaviktup" + "ABEZHIKMNOPTYX",
)
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿]")
# fixed values: letters that do not decompose
PLAIN = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ı": "i", "ð": "d", "þ": "th", "ẞ": "ss"})
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_OTHER = re.compile("[Ͱ-ϿЀ-ԯ]")
_WORD = re.compile(r"[^\W_]+")


def _one_script(word: str) -> str:
    """Lookalike letters are replaced in words that hold Latin letters as well."""
    return word.translate(LOOKALIKES) if _OTHER.search(word) and _LATIN.search(word) else word


class _Plain(dict):
    """Code point -> its folded form, filled as signs are met."""

    def __missing__(self, point: int) -> str:
        sign = unicodedata.normalize("NFKC", INVISIBLE.sub("", chr(point)))
        sign = unicodedata.normalize("NFD", sign.lower().translate(PLAIN)).replace("ς", "σ")
        sign = unicodedata.normalize("NFC", "".join(c for c in sign if unicodedata.category(c) != "Mn" or c in "\u3099\u309a"))
        self[point] = sign
        return sign


_PLAIN = _Plain()
_MIXED = re.compile("[A-Za-zÀ-ɏ]\\d*[Ͱ-ϿЀ-ԯ]|[Ͱ-ϿЀ-ԯ]\\d*[A-Za-zÀ-ɏ]")


def fold(text: str) -> str:
    """Compatibility form, entities read, invisible characters, accents and case removed, lookalike letters in mixed words replaced."""
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return text.lower()
    text = INVISIBLE.sub("", text)
    if _MIXED.search(text):
        text = _WORD.sub(lambda m: _one_script(m[0]), unicodedata.normalize("NFKC", text))
    return unicodedata.normalize("NFC", text.translate(_PLAIN))


# fixed values: digits and signs written for letters
LEET = str.maketrans("013457@$", "oieastas")
_LEET_WORD = re.compile(r"[^\W_]*[a-z@$][^\W_]*")


def unleet(word: str) -> str:
    """Digits inside a word with letters read as letters; decades such as 90s and ordinals stay."""
    if re.fullmatch(r"\d+(s|st|nd|rd|th|bpm|k)?", word) or not re.search(r"[0-9@$]", word):
        return word
    return word.translate(LEET)


@lru_cache(maxsize=65536)
def words(text: str) -> tuple[str, ...]:
    """Words of the folded text."""
    return tuple(_WORD.findall(fold(text)))


def typo_distance(a: str, b: str, most: int) -> int:
    """Edits (insert, drop, replace, swap of neighbours) from a to b, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most and (before is None or min(last) > most):
            return most + 1
        before, last = last, now
    return min(last[-1], most + 1)
