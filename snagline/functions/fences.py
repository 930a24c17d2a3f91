"""Content fences: literal names that must not leave the host, replaced by one automaton however many there are."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

#: Fixed value: what stands for a fenced text.
MARKER = "<redacted:content-fence>"
#: Characters of all fences together; they go to every task.
MOST_CHARS = 16 << 20
#: Texts that are Python strings at a time.
TEXTS = 64


class _Folds(dict):
    """Characters as they compare when case does not count; one for one, so that places stay."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        found = "i" if char in "İı" else next((x for x in (char.casefold(), char.lower()) if len(x) == 1), char)
        self[code] = found
        return found


_FOLDS = _Folds()


def folded(text: str) -> str:
    return text.translate(_FOLDS)


def automaton_of(fences: Iterable[str]) -> ahocorasick.Automaton | None:
    """An automaton of the fences that are not empty; each gives its length."""
    names = {folded(f) for f in fences if f}
    if sum(map(len, names)) > MOST_CHARS:
        raise ValueError(f"fences have {MOST_CHARS} characters at most")
    if not names:
        return None
    found = ahocorasick.Automaton()
    for name in names:
        found.add_word(name, len(name))
    found.make_automaton()
    return found


def without(text: str, automaton: ahocorasick.Automaton) -> str:
    """The text with a marker for each fence: the leftmost first, of those the longest, none over another."""
    longest: dict[int, int] = {}
    for last, length in automaton.iter(folded(text)):
        begin = last + 1 - length
        longest[begin] = max(longest.get(begin, 0), length)
    if not longest:
        return text
    parts, at = [], 0
    for begin in sorted(longest):
        if begin >= at:
            parts += [text[at:begin], MARKER]
            at = begin + longest[begin]
    return "".join([*parts, text[at:]])


def replaced(texts: pa.Array, automaton: ahocorasick.Automaton) -> pa.Array:
    return pa.array([t if t is None else without(t, automaton) for t in texts.to_pylist()], texts.type)


def fenced(fences: Iterable[str]) -> Callable[[Column], Column]:
    """A column function that replaces fences; a task builds its automaton once, texts come in Arrow batches."""
    names = sorted({f for f in fences if f})
    automaton_of(names)  # refuses too many here, not in a task

    @arrow_udf(StringType())
    def replace(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = automaton_of(names)
        for texts in batches:
            yield texts if automaton is None else pa.concat_arrays([replaced(texts.slice(at, TEXTS), automaton) for at in range(0, len(texts), TEXTS)] or [texts])

    return replace
