"""Language identification with word-first backoff.

Words that the training rows know are scored by their log frequency in each
language.  Any other word falls back to its character n-grams, the longest
first: the first length of which an n-gram is known decides.  Runs of letters
are read whole; an unknown one counts as a word for every RUN_LETTERS of its
letters, and once at least.

A model is a few arrays: sorted 64-bit hashes of the tokens, and for each token
only the languages that have it, with how far its log frequency there lies above
the floor that is the same in all languages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snagline.llm.common import add_text_columns, broadcast_if_small, free_name, stored
from snagline.llm.setlink import mixed

#: Bound of the model: labelled training rows of a language.
SAMPLE_ROWS = 500
LONGEST_GRAM = 4
#: Letters of an unknown run that weigh as much as one word.
RUN_LETTERS = 10
#: Added to the count of every known token in every language.
ALPHA = 0.5
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
#: Bytes of the vectors, and letters of the words, that a task remembers.
CACHE_BYTES, CACHE_LETTERS = 8 << 20, 1_000_000
#: Unknown words that are scored together.
GROUPS = 4_096


def is_held_out(doc_id: str | Column) -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 4 == 2


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at each place of a run of code points."""
    count = max(0, len(codes) - n + 1)
    rolling = np.full(count, n, np.uint64)
    for k in range(n):
        rolling = rolling * np.uint64(0x100000001B3) + codes[k : k + count]
    return mixed(rolling)


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def token_hash(n: int, token: str) -> int:
    """Of a word (n = 0) or an n-gram."""
    return int(gram_hashes(code_points(token), n)[0]) if n else word_hash(token)


def _counts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of words (n = 0) and n-grams by language, times the weight of their rows."""
    for batch in batches:
        words: dict[tuple[str, float], Counter] = {}
        for lang, text, weight in zip(batch["lang"], batch["text"], batch["weight"]):
            words.setdefault((lang, weight), Counter()).update(_LETTERS.findall(text.lower()))
        made = []
        for (lang, weight), counts in words.items():
            hashes = np.fromiter(map(word_hash, counts), np.uint64, len(counts))
            times = np.fromiter(counts.values(), np.int64, len(counts)) * weight
            made.append(pd.DataFrame({"lang": lang, "n": 0, "token": hashes.view(np.int64), "c": times}))
            codes, owner, left = _edged(list(counts))
            for n in range(1, LONGEST_GRAM + 1):
                at = np.flatnonzero(left >= n)
                token, place = np.unique(gram_hashes(codes, n)[at], return_inverse=True)
                c = np.bincount(place, weights=times[owner[at]])
                made.append(pd.DataFrame({"lang": lang, "n": n, "token": token.view(np.int64), "c": c}))
        if made:
            yield pd.concat(made)


def _edged(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words between marks, the word of each, and how many stand from there to its end."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    return code_points("".join(f"<{w}>" for w in words)), owner, ends[owner] - np.arange(len(owner))


@dataclass
class LanguageModel:
    """Sorted token hashes; the languages and weights of token i are those at starts[i] to starts[i + 1]."""

    langs: list[str]
    tokens: np.ndarray
    starts: np.ndarray
    lang: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, langs: list[str], lang: np.ndarray, n: np.ndarray, token: np.ndarray, c: np.ndarray) -> LanguageModel:
        """From counts c of tokens (hashes) of kind n in languages (places in langs); words seen once are left out."""
        order = np.lexsort((lang, token))
        lang, n, token, c = lang[order], n[order], token[order], c[order].astype(float)
        sums = np.zeros((LONGEST_GRAM + 1, len(langs)))
        np.add.at(sums, (n, lang), c)
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(token)))
        kept = np.repeat((n[first] > 0) | (np.add.reduceat(c, first) > 1), sizes) if len(first) else np.zeros(0, bool)
        lang, n, token, c = lang[kept], n[kept], token[kept], c[kept]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        sums += ALPHA * np.bincount(n[first], minlength=LONGEST_GRAM + 1)[:, None]
        # a token that a language has not seen has the same frequency in all languages, however much was sampled of each
        floor = ALPHA / np.maximum(sums.max(axis=1, initial=0.0), ALPHA)
        weight = np.log((c + ALPHA) / sums[n, lang]) - np.log(floor[n]) if len(c) else c
        return cls(langs, token[first], np.append(first, len(token)).astype(np.int64), lang.astype(np.int32), weight.astype(np.float32))

    def find(self, hashes: list[int] | np.ndarray) -> np.ndarray:
        """Places of the tokens, -1 for unknown ones."""
        wanted = np.array(hashes, np.uint64)
        if not len(self.tokens):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.tokens, wanted), len(self.tokens) - 1)
        return np.where(self.tokens[at] == wanted, at, -1)

    def vectors(self, places: np.ndarray) -> np.ndarray:
        """A row of weights by language for each token."""
        sizes = self.starts[places + 1] - self.starts[places]
        row = np.repeat(np.arange(len(places)), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.starts[places][row]
        out = np.zeros((len(places), len(self.langs)), np.float32)
        out[row, self.lang[at]] = self.weight[at]
        return out

    def backed_off(self, words: list[str]) -> np.ndarray:
        """For each unknown word what its longest known n-grams say, on average; zeros where none is known."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        codes, owner, left = _edged(words)
        open_ = np.ones(len(words), bool)
        for n in range(LONGEST_GRAM, 0, -1):
            hashes = gram_hashes(codes, n)
            at = np.flatnonzero((left >= n) & open_[owner])
            places = self.find(hashes[at])
            at, places = at[places >= 0], places[places >= 0]
            if not len(at):
                continue
            of = owner[at]
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            times = np.diff(np.append(first, len(of)))
            letters = left[np.searchsorted(owner, of[first])] - 2
            weight = np.maximum(1.0, letters / RUN_LETTERS) / times
            for j in range(0, len(first), GROUPS):  # some words at a time
                a, b = first[j], first[j + GROUPS] if j + GROUPS < len(first) else len(of)
                sums = np.add.reduceat(self.vectors(places[a:b]), first[j : j + GROUPS] - a, axis=0)
                out[of[first[j : j + GROUPS]]] = sums * weight[j : j + GROUPS, None]
            open_[of[first]] = False
        return out

    def scorer(self) -> Callable[[str], tuple[str, float]]:
        """A function from a whole text to (language, share of the likelihood)."""
        width = len(self.langs)
        room = max(1, CACHE_BYTES // (4 * max(1, width)))
        table, met, letters = np.zeros((room, width), np.float32), {}, [0]

        def rows_of(words: list[str]) -> list[int]:
            new = [w for w in words if w not in met]
            if len(met) + len(new) > room or letters[0] > CACHE_LETTERS:
                met.clear()  # words are scored anew when they come again
                letters[0], new = 0, words
            if new:
                places = self.find([word_hash(w) for w in new])
                at = len(met) + np.arange(len(new))
                met.update(zip(new, at.tolist()))
                letters[0] += sum(map(len, new))
                table[at[places >= 0]] = self.vectors(places[places >= 0])
                unknown = np.flatnonzero(places < 0)
                for i in range(0, len(unknown), GROUPS):
                    some = unknown[i : i + GROUPS]
                    table[at[some]] = self.backed_off([new[j] for j in some.tolist()])
            return [met[w] for w in words]

        def score(text: str) -> tuple[str, float]:
            words = Counter(_LETTERS.findall(text.lower()))
            if not words or not self.langs:
                return UNKNOWN, 0.0
            total, several = np.zeros(width), list(words)
            counts = np.fromiter(words.values(), float, len(words))
            for at in range(0, len(several), room):
                rows = rows_of(several[at : at + room])
                total += counts[at : at + room] @ table[rows]
            best = int(total.argmax())
            return self.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())

        return score


def _sampled(rows: DataFrame, sample_rows: int) -> DataFrame:
    """(lang, text, weight) of the training rows, about sample_rows of each language.

    Of c rows that agree in every column, c * sample_rows / rows of the language
    are chosen, rounded up or down by a hash of their content; each of them
    comes with the chosen share of the c as its weight.  So the choice follows
    the content of the table alone, however its rows are split.
    """
    content = [F.col(f"`{c}`") for c in rows.columns]
    named = rows.select("lang", "text", F.xxhash64(*content).alias("h"), F.xxhash64(F.lit(1), *content).alias("h2"))
    keys = stored(named.groupBy("lang", "h", "h2").agg(F.count("*").alias("n")), "languages")
    sizes = keys.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("all"))
    place = F.pmod("h2", F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(F.col("n") * F.least(F.lit(1.0), F.lit(float(sample_rows)) / F.col("all")) + place)
    weighed = keys.join(broadcast_if_small(sizes), F.col("lang") == F.col("of")).select("lang", "h", "h2", (times / F.col("n")).alias("weight"))
    chosen = stored(weighed.where("weight > 0"), "sample")
    return named.join(broadcast_if_small(chosen), ["lang", "h", "h2"]).select("lang", "text", "weight")


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """A model of the columns text and lang of rows.

    At most about sample_rows rows with letters of a language are used, chosen
    by a hash of all columns of rows, so that copies are sampled like other
    rows and the layout decides nothing; a column such as doc_id tells rows of
    equal text apart.  All their words and n-grams are counted in Spark, and
    what is known of each, some bytes, comes to the driver: its size follows
    the sample.  Without rows of a language the model has none.
    """
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = _sampled(rows, sample_rows).mapInPandas(_counts, "lang string, n int, token long, c double")
    each = counts.groupBy("lang", "n", "token").agg(F.round(F.sum("c")).cast("long").alias("c")).toPandas()
    if not len(each):
        none = np.zeros(0, np.int64)
        return LanguageModel.of([], none, none, none.astype(np.uint64), none)
    langs = sorted(each["lang"].unique())
    lang = each["lang"].map({x: j for j, x in enumerate(langs)}).to_numpy(np.int64)
    token = each["token"].to_numpy(np.int64).view(np.uint64)
    return LanguageModel.of(langs, lang, each["n"].to_numpy(np.int64), token, each["c"].to_numpy(np.int64))


def identify(
    docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text", lang: str = "_lang", score: str = "_score"
) -> DataFrame:
    """The columns in keep, then the language and its score of each whole text.

    A null text, one without letters, or a model without languages gives `und`
    and 0.  Rows and repeats stay; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample of train
    return add_text_columns(docs, text, keep, f"`{lang}` string, `{score}` double", lambda: shared.value.scorer())


def _learned_from(docs: DataFrame, held: Column, text: str, lang: str, doc_id: str) -> DataFrame:
    """The rows to learn from; doc_id only tells rows apart when they are sampled."""
    names = {"text": text, "lang": lang, "doc_id": doc_id}
    return docs.where(~held).select(*[F.col(f"`{c}`").cast("string").alias(k) for k, c in names.items()])


def drop_unknown(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, with their columns, less those for which no language is predicted.

    That is a null or empty text, or one without letters.  Where no language was
    learned, nothing can be rejected, and every row stays.  Columns of docs may
    have any name.
    """
    held = F.coalesce(is_held_out(F.col(f"`{doc_id}`").cast("string")), F.lit(False))
    model = train(_learned_from(docs, held, text, lang, doc_id))
    if not model.langs:
        return docs
    found, score = free_name(docs, "lang"), free_name(docs, "score")
    return identify(docs, model, docs.columns, text, found, score).where(F.col(found) != UNKNOWN).drop(found, score)


def predict_languages(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """One row per document with its predicted language.

    Learns from text and non-null lang of the rows whose crc32 of doc_id (as
    text) modulo 4 is not 2, and from nothing else; lang and doc_id are no
    inputs of a prediction.  lang_pred is a learned value, or `und` with score
    0 for a null text, a text without letters, or where nothing was learned.
    score is the share of the winner in the likelihood of all languages.  A
    null doc_id is held in.  Repeated rows stay; other columns are not read.
    An empty table gives no rows.

    Returns doc_id, held_out, lang_pred, score.
    """
    held = F.coalesce(is_held_out(doc_id), F.lit(False))
    model = train(_learned_from(docs, held, text, lang, doc_id))
    rows = identify(docs, model, [doc_id], text)
    return rows.select(
        F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score")
    )
