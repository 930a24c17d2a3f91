"""License scan: exact phrases and fuzzy short notices.

A notice of n characters that may have k errors is cut into k + 1 pieces; one
of them must stand in the text unchanged (pigeonhole).  An automaton finds all
pieces at once; each gives a place where the notice could be, and there the
regex library matches the notice with at most k errors and reports the span.
Every place is looked at by itself, in a window of the notice's length and its
errors; of matches that overlap the one with fewer errors stays, then the first.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snagline.llm.common import LOWER, UPPER, WORD, add_text_columns

#: Fixed by the contract: a phrase of words and its label.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Short notices in lower case, single spaces, and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ("licensed under the apache license, version 2.0", "apache-2"),
    ("licensed under cc by-nc 4.0", "cc-by-nc"),
    ("creative commons attribution-noncommercial", "cc-by-nc"),
    ("creative commons attribution 4.0 international", "cc-by"),
    ("creative commons attribution-noderivatives", "cc-by-nd"),
    ("creative commons zero v1.0 universal", "cc0"),
    ("creative commons attribution-sharealike", "cc-by-sa"),
    ("redistribution and use in source and binary forms, with or without modification", "bsd"),
    ("this program is free software: you can redistribute it and/or modify", "gpl"),
    ("licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("eclipse public license", "epl"),
    ("boost software license, version 1.0", "bsl-1"),
    ("sil open font license", "ofl"),
    ("mozilla public license, version 2.0", "mpl-2"),
    ("permission to use, copy, modify, and/or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
)
#: Windows whose match a task keeps.
KNOWN_WINDOWS = 1 << 16
#: One error for so many characters of a notice.
CHARS_PER_ERROR = 10
_TO_LOWER = str.maketrans(UPPER, LOWER)


def errors_of(notice: str) -> int:
    return len(notice) // CHARS_PER_ERROR


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 pieces that cover the notice."""
    cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def notice_finder() -> Callable[[str], list[tuple[int, int, str, int]]]:
    """A function from a lower-cased text to (start, end, label, errors) of each notice."""
    automaton = ahocorasick.Automaton()
    at: dict[str, list[tuple[int, int, int]]] = {}
    patterns = []
    for k, (notice, label) in enumerate(NOTICES):
        e = errors_of(notice)
        patterns.append((regex.compile(rf"(?be)(?:{regex.escape(notice)}){{e<={e}}}"), len(notice), e, label))
        for offset, piece in pieces(notice, e):
            at.setdefault(piece, []).append((k, offset, len(piece)))
    for piece, uses in at.items():
        automaton.add_word(piece, uses)
    automaton.make_automaton()

    known: dict[tuple[int, str], tuple[int, int, int] | None] = {}

    def best(k: int, window: str) -> tuple[int, int, int] | None:
        """(start, end, errors) of the best match within a window; windows that come again are looked up."""
        if (k, window) not in known:
            if len(known) >= KNOWN_WINDOWS:
                known.clear()
            m = patterns[k][0].search(window)
            known[k, window] = m and (m.start(), m.end(), sum(m.fuzzy_counts))
        return known[k, window]

    def find(text: str) -> list[tuple[int, int, str, int]]:
        windows: dict[int, set[int]] = {}
        for end, uses in automaton.iter(text):
            for k, offset, length in uses:
                windows.setdefault(k, set()).add(end + 1 - length - offset)
        out = []
        for k, begins in windows.items():
            _, n, e, label = patterns[k]
            found = set()
            for begin in begins:
                a = max(0, begin - e)
                if m := best(k, text[a : max(0, begin + n + e)]):
                    found.add((m[2], a + m[0], a + m[1]))
            out += [(a, b, label, errors) for errors, a, b in apart(sorted(found))]
        return sorted(out)

    return find


def apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(errors, start, end) in the given order, without those that overlap one before them."""
    taken: list[tuple[int, int]] = []
    kept = []
    for errors, a, b in spans:
        i = bisect_left(taken, (a, b))
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
            taken.insert(i, (a, b))
            kept.append((errors, a, b))
    return kept


_FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " spans array<struct<start:int,end:int,label:string,errors:int>>"
)


def _scan():
    find, word = notice_finder(), regex.compile(WORD)

    def scan(text: str) -> tuple:
        lower = text.translate(_TO_LOWER)
        words = word.findall(lower)
        starts, labels = [], set()
        if any(all(w in lower for w in phrase.split()) for phrase, _ in PHRASES):
            line = f" {' '.join(words)} "
            for phrase, label in PHRASES:
                spot, at, number = line.find(f" {phrase} "), 0, 0
                while spot >= 0:
                    number += line.count(" ", at, spot)
                    starts.append(number)
                    labels.add(label)
                    at, spot = spot, line.find(f" {phrase} ", spot + 1)
        spans = find(lower)
        nearest = max((1 - e / max(1, b - a) for a, b, _, e in spans), default=0.0)
        return (
            len(words),
            len(starts),
            min(starts, default=None),
            max(starts, default=None),
            ",".join(sorted(labels)),
            ",".join(sorted(labels | {s[2] for s in spans})),
            1.0 if starts else min(1.0, max(0.0, nearest)),
            spans,
        )

    return scan


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document with its license phrases and notices.

    Base phrases stand word by word; notices may have one error (insertion,
    deletion, substitution) for every ten characters, and are found in the text
    with A-Z lower-cased.  score is 1 where a base phrase stands, else the
    share of characters without error of the best notice, else 0.  A null or
    empty text has no words, no labels and score 0.  Repeated rows stay; other
    columns are not read.  An empty table gives no rows.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, spans (code points, end exclusive, with label and errors).
    """
    rows = add_text_columns(docs, text, [doc_id], _FIELDS, _scan)
    return rows.select(F.col(doc_id).alias("doc_id"), *[F.col(c) for c in rows.columns if c != doc_id])
