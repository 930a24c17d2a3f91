"""Words of a text as a search index knows them: folded, split and stemmed."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@lru_cache(1)
def _plain_letters() -> tuple[str, str]:
    """Letters with marks and the letters below the marks, by their decomposition."""
    pairs = []
    for code in range(0x80, min(sys.maxunicode, 0x2000)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and all(unicodedata.combining(x) for x in base[1:]):
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Lower case, without marks on letters."""
    marked, plain = _plain_letters()
    return F.regexp_replace(F.translate(F.lower(text), marked, plain), r"\p{Mn}", "")


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded, in order."""
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}\p{Co}]+"), lambda w: w != "")


def raw_words(text: Column) -> Column:
    """Runs of letters and digits as they are written, with their marks; the first or last may be empty.

    folded_stems makes of each what tokens and stems make of it.
    """
    return F.split(text, r"(?:[^\p{L}\p{N}\p{Co}\p{Mn}]\p{Mn}*)+")


@lru_cache(1)
def _written() -> dict[str, set[str]]:
    """For a letter, the other characters that begin with it when they are folded."""
    plain, found = str.maketrans(*_plain_letters()), {"σ": {"ς"}, "ς": {"σ", "Σ"}}
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        form = char.lower().translate(plain)
        if form != char:
            found.setdefault(form[0], set()).add(char)
    return found


def _letter(char: str) -> str:
    """Every way to write a letter, with marks behind it."""
    return "[" + "".join(f"\\x{{{ord(x):X}}}" for x in sorted({char, *_written().get(char, ())})) + r"]\p{Mn}*"


def _begins(heads: set[str]) -> str:
    """What begins like one of the heads; the longer of two that begin alike does not matter."""
    if "" in heads:
        return ""
    by: dict[str, set[str]] = {}
    for head in heads:
        by.setdefault(head[0], set()).add(head[1:])
    return "(?:" + "|".join(_letter(x) + _begins(rest) for x, rest in sorted(by.items())) + ")"


def word_pattern(heads: list[str] | None) -> str:
    """An expression whose first group is a word, without marks before it, that begins like a folded head; None takes all words."""
    begin = r"[\p{L}\p{N}\p{Co}]" if heads is None else _begins(set(heads))
    # letters are looked at first: few places have the right ones
    free = r"(?:(?<![\p{L}\p{N}\p{Co}\p{Mn}])|(?<=\p{Mn})(?<=(?:^|[^\p{L}\p{N}\p{Co}\p{Mn}])\p{Mn}{1,1000}))"
    return rf"(?={begin}){free}({begin}[\p{{L}}\p{{N}}\p{{Co}}\p{{Mn}}]*)"


#: Fixed values of Porter's published algorithm: suffixes and what they become.
_SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_FOURTH = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel behind a consonant."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _closed(stem: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x and y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replaced(word: str, table: dict[str, str], least: int) -> str:
    suffix = next((s for s in sorted(table, key=len, reverse=True) if word.endswith(s)), None)
    if suffix is not None and _measure(word[: -len(suffix)]) >= least:
        return word[: -len(suffix)] + table[suffix]
    return word


def stem(word: str) -> str:
    """Porter's stem of a word in lower case; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in _shape(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _closed(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _SECOND, 1), _THIRD, 1)
    suffix = next((s for s in sorted(_FOURTH, key=len, reverse=True) if word.endswith(s)), None)
    if suffix is not None and _measure(word[: -len(suffix)]) > 1 and (suffix != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(suffix)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        word = word[:-1] if m > 1 or m == 1 and not _closed(word[:-1]) else word
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@pandas_udf(StringType())
def stems(words: pd.Series) -> pd.Series:
    known = {w: stem(w) for w in words.unique()}
    return words.map(known)


@pandas_udf(StringType())
def folded_stems(words: pd.Series) -> pd.Series:
    """Stems of words as they are written: in lower case, without marks."""
    plain = str.maketrans(*_plain_letters())

    def form(word: str) -> str:
        return stem("".join(x for x in word.lower().translate(plain) if unicodedata.category(x) != "Mn"))

    known = {w: form(w) for w in words.unique()}
    return words.map(known)
