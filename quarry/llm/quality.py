"""Quality rules with a line-labelling conditional random field.

Every line of a text gets a feature vector; a linear-chain CRF with the labels content and boilerplate
scores the line features and the transitions, and Viterbi decoding marks the lines.  A document is kept if its
content lines hold enough of its word characters and the fixed base rules don't reject it.

The CRF is fitted on the driver from document labels alone, on at most FIT_DOCS labelled documents of FIT_CHARS characters
(the bound concerns the fit; decoding covers every line).  Which lines of a document are boilerplate isn't given, so they are latent: all
lines start with their document's label, lines are judged one by one, then labels and CRF are improved in turns.  A bad document
keeps at least one boilerplate line, a good one content for half of its word characters at least.  The share of content that a document
needs is fitted too: of the steps from MIN_CONTENT up, the first that parts good from bad documents best.

Defined cases: null, empty or blank text has no words, fails the base rules and isn't kept; lines without a word
are not labelled; on a tie a line is content; repeated rows are judged each; very long texts are whole; without labels of both kinds the
model falls back to PRIOR; an empty documents table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, sampled

FIT_DOCS, FIT_CHARS, FIT_LINES, MIN_CONTENT = 1500, 200_000, 32, 0.5
#: Turns of labelling and fitting; gradient steps of the first fit and of each turn's.
TURNS, FIRST_STEPS, STEPS = 5, 80, 40
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in b"#*$%&|<>")
_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_ALPHA = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 0x80))
_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_MARKS = bytes(b for b in range(256) if b not in b"!?")
FEATURES = ("bias", "words", "short", "symbols", "upper", "digits", "marks", "ends", "repeated", "word_repeats", "long_words")
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "content_share double, labels string"
)


def line_features(line: bytes, earlier: bool) -> list[float]:
    """Shares and flags between 0 and 1 about, of a line with a word."""
    own = line.split()
    n, size = len(own), max(1, len(line))
    tail = own[-1][-1:]
    return [
        1.0,
        min(n, 40) / 40,
        float(n < 4),
        min(1.0, 4 * len(line.translate(None, _NOT_SYMBOLS)) / size),
        len(line.translate(None, _UPPER)) / max(1, len(line.translate(None, _ALPHA))),
        len(line.translate(None, _DIGIT)) / size,
        min(1.0, 8 * len(line.translate(None, _MARKS)) / size),
        float(tail in (b".", b"?", b"!", b":", b'"')),
        float(earlier),
        1 - len(set(own)) / n,
        sum(len(w) > 24 for w in own) / n,
    ]


def lines_of(text: bytes) -> tuple[list[bytes], list[list[float]], int]:
    """Lines with a word, their features, and how many equal an earlier line."""
    seen, lines, features, dup = set(), [], [], 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            earlier = line in seen
            dup += earlier
            seen.add(line)
            lines.append(line)
            features.append(line_features(line, earlier))
    return lines, features, dup


class Crf:
    """Two labels (0 boilerplate, 1 content): emission weights (2, features) and transitions (2, 2); min_content is for documents."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, min_content: float = MIN_CONTENT):
        self.emit, self.move, self.min_content = emit, move, min_content

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        score = features @ self.emit.T
        n = len(score)
        best, back = score[0], np.empty((n, 2), dtype=np.int8)
        m = self.move
        a0, a1 = float(best[0]), float(best[1])
        m00, m01, m10, m11 = m[0, 0], m[0, 1], m[1, 0], m[1, 1]
        for i, (s0, s1) in enumerate(score[1:].tolist(), 1):
            from0 = (a0 + m00, a1 + m10)
            from1 = (a0 + m01, a1 + m11)
            back[i] = from0[1] > from0[0], from1[1] > from1[0]
            a0, a1 = max(from0) + s0, max(from1) + s1
        out = np.empty(n, dtype=np.int8)
        out[-1] = a1 >= a0
        for i in range(n - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out


#: Used where no labels exist: symbols, shouting and repeats speak against a line.
PRIOR = Crf(
    np.array([[0.0] * 11, [1.0, 1.0, -0.5, -6.0, -4.0, -2.0, -4.0, 0.5, -3.0, -2.0, -1.0]]), np.array([[0.5, 0.0], [0.0, 0.5]])
)


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp(np.take(a, 0, axis), np.take(a, 1, axis))


def marginals(x: np.ndarray, mask: np.ndarray, crf: Crf) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded sequences: probabilities of labels (n, lines, 2) and of label pairs (n, lines - 1, 2, 2)."""
    s, move, width = x @ crf.emit.T, crf.move, x.shape[1]
    fwd, bwd = np.empty_like(s), np.zeros_like(s)
    fwd[:, 0] = s[:, 0]
    for t in range(1, width):
        new = s[:, t] + _logsum(fwd[:, t - 1, :, None] + move, 1)
        fwd[:, t] = np.where(mask[:, t, None] > 0, new, fwd[:, t - 1])
    for t in range(width - 2, -1, -1):
        new = _logsum(move + (s[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
        bwd[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0)
    total = _logsum(fwd[:, -1], 1)
    node = np.exp(np.minimum(fwd + bwd - total[:, None, None], 0)) * mask[:, :, None]
    steps = fwd[:, :-1, :, None] + move + (s + bwd)[:, 1:, None, :] - total[:, None, None, None]
    return node, np.exp(np.minimum(steps, 0)) * mask[:, 1:, None, None]


def ascend(x, mask, labels, weight, crf: Crf, steps: int, chained: bool, rate: float = 3.0, decay: float = 1e-3) -> Crf:
    """Gradient ascent with momentum on the conditional log-likelihood of labels; unchained, transitions stay as they are."""
    emit, move = crf.emit.copy(), crf.move.copy()
    speed = [np.zeros_like(emit), np.zeros_like(move)]
    gold = np.eye(2)[labels] * mask[:, :, None]
    gold_move = np.einsum("nti,ntj,n->ij", gold[:, :-1], gold[:, 1:], weight)
    for _ in range(steps):
        node, pair = marginals(x, mask, Crf(emit, move))
        up = [
            np.einsum("ntl,ntf,n->lf", gold - node, x, weight) - decay * emit,
            gold_move - np.einsum("ntij,n->ij", pair, weight) - decay * move,
        ]
        for p, g, v in list(zip((emit, move), up, speed))[: 1 + chained]:
            v *= 0.9
            v += rate * g
            p += v
    return Crf(emit, move)


def _relabelled(content: np.ndarray, chars: np.ndarray, good: int) -> np.ndarray:
    """Labels of a document's lines from their probability of being content."""
    out = (content >= 0.5).astype(np.int8)
    if good:
        return out if chars[out == 1].sum() >= 0.5 * chars.sum() else np.ones_like(out)
    out[np.argmin(content)] = 0
    return out


def _least_share(shares: np.ndarray, good: np.ndarray) -> float:
    steps = np.arange(MIN_CONTENT, 1.0, 0.05)
    right = [(shares[good == 1] >= t).mean() + (shares[good == 0] < t).mean() for t in steps]
    return round(float(steps[int(np.argmax(right))]), 2)


def fit_crf(texts: list[bytes], good: list[int]) -> Crf:
    """From whole texts and their documents' labels; sequences are runs of at most FIT_LINES lines."""
    docs = [(np.array(f), np.array([len(b"".join(x.split())) for x in lines]), g) for t, g in zip(texts, good) for lines, f, _ in [lines_of(t)] if f]
    if len({g for _, _, g in docs}) < 2:
        return PRIOR
    runs = [(d, at) for d, (f, _, _) in enumerate(docs) for at in range(0, len(f), FIT_LINES)]
    n, width = len(runs), min(FIT_LINES, max(len(f) for f, _, _ in docs))
    x, mask = np.zeros((n, width, len(FEATURES))), np.zeros((n, width))
    for i, (d, at) in enumerate(runs):
        part = docs[d][0][at : at + FIT_LINES]
        x[i, : len(part)], mask[i, : len(part)] = part, 1
    of = np.array([docs[d][2] for d, _ in runs])
    # Good and bad documents weigh the same in all, and so does each document of a kind, whatever its lines.
    lines = np.array([len(docs[d][0]) for d, _ in runs])
    count = np.array([sum(g == k for _, _, g in docs) for k in (0, 1)])
    weight = 0.5 / count[of] / lines
    labels = np.repeat(of[:, None], width, axis=1)
    crf = ascend(x, mask, labels, weight, Crf(np.zeros((2, len(FEATURES))), np.zeros((2, 2))), FIRST_STEPS, False)
    for _ in range(TURNS):
        content = marginals(x, mask, crf)[0][:, :, 1]
        own: dict[int, list] = {}
        for i, (d, _) in enumerate(runs):
            own.setdefault(d, []).append(content[i, : int(mask[i].sum())])
        new = {d: _relabelled(np.concatenate(parts), docs[d][1], docs[d][2]) for d, parts in own.items()}
        for i, (d, at) in enumerate(runs):
            part = new[d][at : at + FIT_LINES]
            labels[i, : len(part)] = part
        crf = ascend(x, mask, labels, weight, crf, STEPS, True)
    shares = np.array([c[crf.viterbi(f) == 1].sum() / c.sum() for f, c, _ in docs])
    return Crf(crf.emit, crf.move, _least_share(shares, np.array([g for _, _, g in docs])))


def fitted(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> Crf:
    """The CRF of a bounded sample of labelled documents, collected to the driver."""
    rows = sampled(docs, labels, "quality", fit_docs, fit_chars)
    return fit_crf([t.encode() for t, _ in rows], [int(q == 1) for _, q in rows])


def repeat_words(own: list[bytes]) -> int:
    """Words in 3-word windows that stand in the text twice or more."""
    n = len(own)
    if n < 4:
        return 0
    grams = list(zip(own, own[1:], own[2:]))
    if len(set(grams)) == n - 2:
        return 0
    count = Counter(grams)
    upto = total = 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def measured(docs: DataFrame, model: Crf) -> DataFrame:
    """SCHEMA's columns; labels has c or b for each line with a word."""

    def make():
        def f(doc_ids, texts):
            out = [[] for _ in range(8)]
            for doc_id, text in zip(doc_ids, texts):
                own = text.split()
                lines, features, dup = lines_of(text)
                share, marks = 0.0, ""
                if lines:
                    got = model.viterbi(np.array(features))
                    chars = np.array([len(b"".join(x.split())) for x in lines])
                    share = float(chars[got == 1].sum() / max(1, chars.sum()))
                    marks = "".join("bc"[i] for i in got)
                row = (
                    doc_id,
                    len(own),
                    len(b"".join(own).decode()),
                    len(text.translate(None, _NOT_SYMBOLS)),
                    dup,
                    repeat_words(own),
                    share,
                    marks,
                )
                for column, v in zip(out, row):
                    column.append(v)
            return out

        return f

    return map_texts(docs, ["doc_id", "text"], SCHEMA, make)


BASE_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fitted(docs, labels)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.col("content_share") >= model.min_content)
    lines = [(F.length("labels") - F.length(F.replace("labels", F.lit(c), F.lit("")))).alias(name) for c, name in (("c", "n_content"), ("b", "n_boilerplate"))]
    return measured(docs, model).withColumn("base_failed", failed).select(*BASE_COLUMNS, kept.alias("kept"), "content_share", *lines)


_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Base columns of op10 (the CRF's verdict isn't SQL).
BASE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE trim(line, {_TRIM}) <> '' GROUP BY r, line),
dup AS (SELECT r, sum(n - 1) AS n FROM l GROUP BY r),
g AS (SELECT r, i, w[i : i + 2] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT r, gram FROM g GROUP BY r, gram HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM g JOIN again USING (r, gram)) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup ON d.r = dup.r LEFT JOIN rep ON d.r = rep.r
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
"""
