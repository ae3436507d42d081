"""Language identification by word-first backoff.

A word that the model knows scores by its log frequency in each language; an unseen word falls back to its
longest known character n-grams, shorter and shorter, place by place.  A text's score of a language is the sum over its words.

The model is fitted on at most FIT_DOCS documents of at most FIT_CHARS characters with a language (those whose id hashes
least, each id once); the bound concerns the fit alone.  It holds words seen MIN_COUNT times there and n-grams of 1 to 4 characters, with the sampled
text as their proven bound.

Defined cases: null text, or text without a letter, gives "und" with score 0; with no
labelled document every text is "und"; repeated rows are judged each; very long texts are whole; extra columns are
ignored; a tie goes to the language first by name; an empty documents table gives an empty result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, sampled, shared

FIT_DOCS, FIT_CHARS, MIN_COUNT, LONGEST = 2000, 200_000, 2, 4
_WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, lang_pred string, score double"


def words(text: str) -> list[str]:
    """Runs of letters, lower-cased.  The expression also takes numbers that are no decimal digits, like a half or a Roman twelve."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


class Model:
    """known and grams number the entries of words and of n-grams; scores has a row for each."""

    def __init__(self, langs: list[str], known: dict[str, int], grams: dict[str, int], scores: np.ndarray, cache_words: int = 200_000):
        self.langs, self.grams, self.n_known = langs, grams, len(scores)
        self.rows, self.most = dict(known), cache_words
        self.uid = uuid.uuid4().hex
        self.scores = np.vstack([scores, np.zeros((cache_words + 1, len(langs)))])

    def __reduce__(self):
        keep = {w: i for w, i in self.rows.items() if i < self.n_known}
        return shared, (Model, self.uid, (self.langs, keep, self.grams, self.scores[: self.n_known], self.most))

    def backoff(self, word: str) -> np.ndarray:
        """Mean score of the n-grams that cover ^word$ from the left, the longest known one at each place."""
        marked, get, at = f"^{word}$", self.grams.get, 0
        found = []
        while at < len(marked):
            for size in range(LONGEST, 0, -1):
                if (row := get(marked[at : at + size])) is not None:
                    found.append(row)
                    at += size
                    break
            else:
                at += 1
        return self.scores[found].sum(axis=0) / max(1, len(found))

    def learn(self, words: list[str]) -> None:
        """Unseen words' scores go to the rows after the known ones, which are reused when full."""
        if len(self.rows) - self.n_words + len(words) > self.most:
            self.rows = {w: i for w, i in self.rows.items() if i < self.n_known}
        for w in words:
            at = self.n_known + len(self.rows) - self.n_words
            self.scores[at] = self.backoff(w)
            self.rows[w] = at

    @property
    def n_words(self) -> int:
        return self.n_known - len(self.grams)

    def predict(self, text: str) -> tuple[str, float]:
        """The language and its share of the posterior of a text's words, tempered by their number."""
        count = Counter(words(text))
        if not count or not self.langs:
            return "und", 0.0
        total = np.zeros(len(self.langs))
        entries = list(count.items())
        for part in range(0, len(entries), self.most):
            own = dict(entries[part : part + self.most])
            if unseen := [w for w in own if w not in self.rows]:
                self.learn(unseen)
                if back := [w for w in own if w not in self.rows]:
                    self.learn(back)
            rows = list(map(self.rows.__getitem__, own))
            total += np.array(list(own.values()), dtype=float) @ self.scores[rows]
        at = int(np.argmax(total))
        share = np.exp((total - total[at]) / math.sqrt(sum(count.values())))
        return self.langs[at], float(1 / share.sum())


def _log_rows(counts: list[Counter], least: int) -> dict[str, np.ndarray]:
    """Log frequency in each language less its mean over languages, of entries seen least times in all."""
    both = sum(counts, Counter())
    total = np.array([sum(c.values()) for c in counts], dtype=float) + 0.1 * (len(both) + 1)
    out = {}
    for k, n in both.items():
        if n >= least:
            score = np.log((np.array([c[k] for c in counts]) + 0.1) / total)
            out[k] = score - score.mean()
    return out


def fit_counts(texts: list[tuple[str, str]]) -> Model:
    """From (language, text)."""
    langs = sorted({lang for lang, _ in texts})
    at = {lang: i for i, lang in enumerate(langs)}
    count, grams = [Counter() for _ in langs], [Counter() for _ in langs]
    for lang, text in texts:
        count[at[lang]].update(words(text))
    for own, found in zip(count, grams):
        for w, n in own.items():
            marked = f"^{w}$"
            for size in range(1, LONGEST + 1):
                for k in range(len(marked) - size + 1):
                    found[marked[k : k + size]] += n
    known, parts = _log_rows(count, MIN_COUNT), _log_rows(grams, MIN_COUNT)
    scores = np.array([*known.values(), *parts.values()]).reshape(len(known) + len(parts), len(langs))
    return Model(langs, {w: i for i, w in enumerate(known)}, {g: i + len(known) for i, g in enumerate(parts)}, scores)


def fitted(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> Model:
    """The model of a bounded sample of documents with text and lang, collected to the driver."""
    able = docs.where("text is not null and lang is not null")
    return fit_counts(sorted((lang, text) for text, lang in sampled(able, able, "lang", fit_docs, fit_chars)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    def make():
        def f(doc_ids, texts):
            got = [model.predict(t.decode()) for t in texts]
            return [doc_ids, [g[0] for g in got], [g[1] for g in got]]

        return f

    return map_texts(docs, ["doc_id", "text"], SCHEMA, make)


def held_out(mod: int, rest: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def op1(docs: DataFrame) -> DataFrame:
    model = fitted(docs.where(~held_out(4, 2)))
    return identify(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
