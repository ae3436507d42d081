"""Toxicity by noisy-channel deobfuscation.

A token that may be disguised (digits or signs among letters, a letter three times in a row, letters or chunks of letters that stand
apart, a doubled letter or a word run into others) opens a lattice of what each character may stand for, what may be dropped, which
repeats may collapse and where words may end; Viterbi decoding under a character trigram model, with a price for each change,
finds the likeliest plain words.  Texts are then scored on restored words and their stems: a stem counts where two different tokens
or more, and one in SHARE of the different tokens of the text or of the stretch from one of them to the next, begin with it, so a
passage scores alike in a short and a very long text.  A feature's weight is the lower bound of its precision among labelled documents,
near copies counting as one, and the strongest feature decides (a text is as toxic as its worst word).  A word that is much weaker
evidence than its own stem counts by the stem alone.

The character model counts the words of all documents.  Letters beyond the Latin alphabets, for which no sign stands, are one class in
it, which bounds its table by the alphabet's third power.  The weights are fitted on at most FIT_DOCS labelled documents of at
most FIT_CHARS characters (those whose id hashes least); the bound concerns the weights alone.

Defined cases: null, empty or wordless text scores the base rate; repeated rows are scored each; an id's repeated labels count once, the
greatest; very long texts are whole; equally likely readings count alike; without labels every score is 0; an empty documents table
gives an empty result; extra columns are ignored by :func:`scored` and kept by :func:`drop_toxic`.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import light_batches, map_texts, release, sampled, shared, slices
from .language_id import held_out

FIT_DOCS, FIT_CHARS, THRESHOLD = 6000, 200_000, 0.7
SCHEMA = "doc_id long, score double"
STEM_LENGTHS, STEM_TOKENS, SHARE, STEM_LEAD = range(3, 8), 2, 100, 0.05
BANDS, BAND_ROWS = 12, 4
#: Letters that a sign or digit may stand for.
LEET = {
    "0": "o",
    "1": "il",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
    "£": "l",
}
_EDGE = " \t\n\x0b\x0c\r.,;:?\"'()[]{}<>|*#&%_-~`!"
_REPEAT = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"(.)\1")
LETTER_PRICE, DROP_PRICE, BREAK_PRICE, MARGIN = -1.0, -0.5, -2.0, 5.0
#: A chunk has at most so many letters; a chunk is a word of its own if it is one in so many of all words.
CHUNK, CHUNK_SHARE = 3, 100_000
#: Words that are looked for inside others, and those others, have so many letters at least.
INNER, OUTER = 5, 8


_BEYOND = re.compile("[^\x00-\u024f]")


def folded(text: str) -> str:
    """Letters beyond the Latin alphabets as one class."""
    return text if text.isascii() else _BEYOND.sub("\u0250", text)


class CharModel:
    """Interpolated character trigrams of words, ^ and $ as ends, from their counts; chunks are short words that are often words."""

    def __init__(self, three: dict[str, int], chunks: frozenset[str] = frozenset()):
        one, two = Counter(), Counter()
        for g, n in three.items():
            one[g[2]] += n
            two[g[1:]] += n
        self.one, self.two, self.three, self.chunks = dict(one), dict(two), dict(three), chunks
        left, left2 = Counter(), Counter()
        for g, n in three.items():
            left2[g[:2]] += n
        for g, n in two.items():
            left[g[0]] += n
        self.left, self.left2, self.all = dict(left), dict(left2), sum(one.values()) + 1
        self.memo: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def log(self, gram: str) -> float:
        if (got := self.memo.get(gram)) is None:
            asked, gram = gram, folded(gram)
            p1 = (self.one.get(gram[2], 0) + 0.01) / self.all
            p2 = (self.two.get(gram[1:], 0) + 8 * p1) / (self.left.get(gram[1], 0) + 8)
            p3 = (self.three.get(gram, 0) + 4 * p2) / (self.left2.get(gram[:2], 0) + 4)
            if len(self.memo) > 30_000:
                self.memo.clear()
            got = self.memo[asked] = math.log(p3)
        return got


def lattice(token: str, ends: bool = False) -> list[list[tuple[str, float]]]:
    """For each run of a character: what it may read, with prices; a blank ends a word, at signs and, with ends, after or between letters."""
    out, i = [], 0
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and token[j] == c:
            j += 1
        run, i = j - i, j
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, 3 * LETTER_PRICE if run == 2 else 0.0))
            if run > 1:
                options.append((c * 2, 0.0))
        for letter in LEET.get(c, ""):
            options.append((letter, LETTER_PRICE))
            if run > 1:
                options.append((letter * 2, LETTER_PRICE))
        if c not in LEET and not c.isalnum():
            options.append(("", DROP_PRICE))
        if not c.isalnum():
            options.append((" ", BREAK_PRICE))
        elif not options:
            options.append((c, 4 * LETTER_PRICE))
        if ends:
            options += [(f"{x} ", p) for x, p in options if x.strip()] + [(f"{x[0]} {x[1:]}", p) for x, p in options if len(x) == 2]
        out.append(options)
    return out


def decode(token: str, model: CharModel, ends: bool = False) -> list[str]:
    """Readings of a token, words with blanks between them, likeliest first: Viterbi over the lattice, states are the last two characters.

    Of each last state the best path remains; readings over MARGIN less likely than the best are left out."""
    states: dict[str, tuple[float, tuple]] = {"^^": (0.0, ())}
    for options in lattice(token, ends):
        after: dict[str, tuple[float, tuple]] = {}
        for state, (score, path) in states.items():
            for letters, price in options:
                s, at = score + price, state
                for c in letters:
                    if c == " ":
                        s, at = s + model.log(at + "$"), "^^"
                    else:
                        s += model.log(at + c)
                        at = at[1] + c
                if at not in after or s > after[at][0]:
                    after[at] = (s, (path, letters) if letters else path)
        states = after
    last = sorted(((s + (0.0 if at == "^^" else model.log(at + "$")), at) for at, (s, _) in states.items()), reverse=True)
    out = []
    for s, at in last:
        if s >= last[0][0] - MARGIN:
            parts, path = [], states[at][1]
            while path:
                path, letters = path
                parts.append(letters)
            if parts:
                out.append("".join(reversed(parts)).strip())
    return [x for x in out if x]


def disguised(token: str) -> bool:
    return not token.isalpha() or bool(_REPEAT.search(token))


class Tokens:
    """Lower-cased blank-separated tokens of a text; single characters and chunks of letters in a row come as one, with its blanks.

    Chunks that are words of their own, by the character model, are left alone."""

    def __init__(self, chunks: frozenset[str], most: int = 50_000):
        self.chunks, self.most = chunks, most
        self.bare: dict[str, str | None] = {}

    def chunk(self, token: str) -> str | None:
        """The character or chunk that a token is, else None."""
        bare = token if len(token) == 1 else token.strip(_EDGE)
        if len(bare) != 1 and not (1 < len(bare) <= CHUNK and bare.isalpha() and bare not in self.chunks):
            bare = None
        if len(self.bare) >= self.most:
            self.bare.clear()
        self.bare[token] = bare
        return bare

    def of(self, text: str) -> list[str]:
        tokens = text.lower().split()
        get, chunk = self.bare.get, self.chunk
        found = [(i, bare) for i, t in enumerate(tokens) if len(t) <= CHUNK + 2 and (bare := get(t, "") or (None if t in self.bare else chunk(t)))]
        if len(found) < 2:
            return tokens
        out, done, first = [], 0, 0
        for k in range(1, len(found) + 1):
            if k < len(found) and found[k][0] == found[k - 1][0] + 1:
                continue
            run = [bare for _, bare in found[first:k]]
            if len(run) >= 3 or len(run) == 2 and len(run[0]) + len(run[1]) > CHUNK:
                out += tokens[done : found[first][0]]
                out.append(" ".join(run))
                done = found[k - 1][0] + 1
            first = k
        return out + tokens[done:] if done else tokens


def squeezed(word: str) -> str:
    """Every doubled letter once."""
    return _DOUBLE.sub(r"\1", word)


def _stems(word: str) -> tuple[str, ...]:
    return tuple(f"{word[:n]}*" for n in STEM_LENGTHS if len(word) >= n)


def _stretches(tokens: list[str]) -> list[int]:
    """For each place the end of the longest stretch from it with STEM_TOKENS * SHARE different tokens at most."""
    most, n = STEM_TOKENS * SHARE, len(tokens)
    held: Counter = Counter()
    ends, end = [], 0
    for token in tokens:
        while end < n and (len(held) < most or tokens[end] in held):
            held[tokens[end]] += 1
            end += 1
        ends.append(end)
        held[token] -= 1
        if not held[token]:
            del held[token]
    return ends


def _near(places: Iterable[tuple[int, str, str]], ends: list[int], different: int) -> set[str]:
    """Stems that recur, from (place, token, stem) in order of place, in a text of so many different tokens."""
    out, last, found = set(), {}, {}
    for at, token, stem in places:
        before, was = last.get(stem, (at, token))
        if was != token and at < ends[before]:
            out.add(stem)
        last[stem] = at, token
        found.setdefault(stem, set()).add(token)
    return out | {stem for stem, own in found.items() if len(own) >= STEM_TOKENS and len(own) * SHARE >= different}


def _recurring(words: list[tuple[int, str, str]], tokens: list[str], among: set[str] | None = None) -> set[str]:
    """Stems that recur, from (place, token, word); a longer stem's words are among a shorter one's, also of those asked for."""
    out, live, ends, different = set(), words, None, len(set(tokens))
    for n in STEM_LENGTHS:
        if among is not None:
            live = [x for x in live if f"{x[2][:n]}*" in among]
        if not live:
            break
        ends = ends or _stretches(tokens)
        good = _near(((at, t, w[:n]) for at, t, w in live if len(w) >= n), ends, different)
        out.update(f"{p}*" for p in good)
        live = [x for x in live if x[2][:n] in good]
    return out


class Model:
    """known: words seen plain among the labelled documents, which need no restoring."""

    def __init__(self, chars: CharModel, weight: dict[str, float], base: float, known: frozenset[str] = frozenset(), cache_words: int = 50_000):
        self.chars, self.weight, self.base, self.known, self.most = chars, weight, base, known, cache_words
        self.cache: dict[str, tuple[float, tuple[str, ...]]] = {}
        self.tokens = Tokens(chars.chunks)
        self.starts = {f[: STEM_LENGTHS[0]] for f in weight if f[-1] == "*"}
        own = sorted(f for f in weight if f[-1] != "*")
        self.by_squeezed: dict[str, list[str]] = {}
        for w in own:
            self.by_squeezed.setdefault(squeezed(w), []).append(w)
        self.inner = None
        if inner := [w for w in own if len(w) >= INNER]:
            import ahocorasick

            self.inner = ahocorasick.Automaton()
            for w in inner:
                self.inner.add_word(w, w)
            self.inner.make_automaton()
        self.uid = uuid.uuid4().hex

    def __reduce__(self):
        return shared, (Model, self.uid, (self.chars, self.weight, self.base, self.known, self.most))

    def phrases(self, token: str) -> list[str]:
        """What may stand behind a token without blanks, likeliest first; words are parted by blanks."""
        bare = token.strip(_EDGE)
        if not bare:
            out = []
        elif not disguised(bare):
            out = [bare, *self.hidden(bare)]
        elif not any(map(str.isalpha, bare)):
            out = [bare]
        else:
            out = decode(bare, self.chars)
        if len(bare) < len(token) and (token[0] in LEET or token[-1] in LEET) and any(map(str.isalpha, token)):
            out = [*out, *decode(token, self.chars)]
        return out

    def hidden(self, bare: str) -> list[str]:
        """Weighted words in a plain one that is not known: with letters doubled, or run into others."""
        out: list[str] = []
        if bare not in self.known:
            if _DOUBLE.search(bare):
                out += self.by_squeezed.get(squeezed(bare), ())
            if len(bare) >= OUTER and self.inner and next(self.inner.iter(bare), None):
                out += decode(bare, self.chars, True)
        return out

    def readings(self, token: str) -> list[str]:
        """The plain words that may stand behind a token; of a spaced-out run, the words found in it."""
        if " " not in token:
            return [w for phrase in self.phrases(token) for w in phrase.split()]
        run = token.replace(" ", "")
        # Also without its first or last letter, which may be a word, and as the words that the lattice parts.
        wholes = [run] if len(run) == 3 else [run, run[1:], run[:-1]]
        out = [p for whole in wholes for p in self.phrases(whole)]
        if any(map(str.isalpha, run)):
            out += decode(run, self.chars, True)
        return list(dict.fromkeys(w for phrase in out for w in phrase.split()))

    def likeliest(self, token: str) -> list[str]:
        """The words of the likeliest reading; of a spaced-out run, all found in it."""
        return self.readings(token) if " " in token else [w for phrase in self.phrases(token)[:1] for w in phrase.split()]

    def of(self, token: str) -> tuple[float, tuple[str, ...]]:
        """The weight of a token's worst reading, and the weighted stems of its readings."""
        if (got := self.cache.get(token)) is None:
            weight, starts = self.weight, self.starts
            read = [token] if token.isalpha() and not _DOUBLE.search(token) and len(token) < OUTER else self.readings(token)
            worst = max([weight.get(w, 0.0) for w in read], default=0.0)
            got = worst, tuple({f for w in read if w[: STEM_LENGTHS[0]] in starts for f in _stems(w) if f in weight})
            if len(token) <= 64:  # long ones hardly recur
                if len(self.cache) >= self.most:
                    self.cache.clear()
                self.cache[token] = got
        return got

    def score(self, text: str) -> float:
        cache, of, worst, tokens = self.cache, self.of, self.base, self.tokens.of(text)
        stemmed: dict[str, tuple[str, ...]] = {}
        for t in set(tokens):
            weight, stems = cache[t] if t in cache else of(t)
            if weight > worst:
                worst = weight
            if stems:
                stemmed[t] = stems
        if len(stemmed) > 1:
            places = ((i, t, f) for i, t in enumerate(tokens) if t in stemmed for f in stemmed[t])
            near = _near(places, _stretches(tokens), len(set(tokens)))
            worst = max([worst, *(self.weight[f] for f in near)])
        return max(worst, 0.0)


def _bound(hits: float, n: float, z: float = 1.5) -> float:
    """Lower end of Wilson's interval."""
    p, zz = hits / n, z * z
    return (p + zz / (2 * n) - z * math.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


def families(texts: list[str]) -> list[int]:
    """For each text the first one it is a near copy of, through others perhaps: some band of minima over 3-word shingles agrees."""
    draws = np.random.default_rng(7).integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
    first, seen = list(range(len(texts))), {}

    def root(i: int) -> int:
        while first[i] != i:
            first[i] = i = first[first[i]]
        return i

    for i, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        h = np.array([zlib.crc32(w.encode()) for w in words], np.uint64)
        h = np.concatenate([h, h[-1:], h[-1:]])
        h = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[2:] * np.uint64(0x165667B19E3779F9))
        h = np.unique(h ^ (h >> np.uint64(29)))
        least = np.array([(h * d).min() for d in draws], np.uint64)
        for b in range(BANDS):
            at = seen.setdefault((b, least[b * BAND_ROWS : (b + 1) * BAND_ROWS].tobytes()), i)
            low, high = sorted((root(at), root(i)))
            first[high] = low
    return [root(i) for i in range(len(texts))]


def _unexplained(weight: dict[str, float]) -> dict[str, float]:
    """weight without words and shorter stems that are weaker by over STEM_LEAD than a stem they share."""
    stems = {f[:-1]: w for f, w in weight.items() if f[-1] == "*"}
    best = dict(stems)
    for stem, w in stems.items():
        for n in STEM_LENGTHS:
            if n < len(stem) and stem[:n] in best:
                best[stem[:n]] = max(best[stem[:n]], w)

    def rival(f: str) -> float:
        if f[-1] == "*":
            return best[f[:-1]]
        return max((stems.get(f[:n], 0.0) for n in STEM_LENGTHS), default=0.0)

    return {f: w for f, w in weight.items() if w + STEM_LEAD >= rival(f)}


def char_model(three: dict[str, int], short: dict[str, int]) -> CharModel:
    """From the counts of trigrams and of short words; each word ends in one trigram."""
    n = sum(c for g, c in three.items() if g[2] == "$")
    return CharModel(three, frozenset(w for w, c in short.items() if c >= 2 and c * CHUNK_SHARE >= n))


def counted(words: Counter) -> tuple[Counter, Counter]:
    """Counts of the trigrams of plain words, and of the short ones."""
    three, short, by_count = Counter(), Counter(), {}
    for token, n in words.items():
        bare = token.strip(_EDGE)
        if bare and not disguised(bare):
            by_count.setdefault(n, []).append(bare)
    for n, own in by_count.items():
        s = folded(f"^^{'$^^'.join(own)}$")
        for (a, b, c), times in Counter(zip(s, s[1:], s[2:])).items():
            if a != "$" and b != "$":  # those reach into the next word
                three[a + b + c] += n * times
        for w in own:
            if len(w) <= CHUNK:
                short[folded(w)] += n
    return three, short


def corpus_chars(docs: DataFrame, flush: int = 50_000) -> CharModel:
    """The character model of all documents.  Tasks count words, at most about flush at a time, and give sums by trigram."""
    import pyarrow as pa

    light_batches(docs.sparkSession)

    def run(batches):
        def rows():
            three, short = counted(words)
            words.clear()
            names, sums = [*three, *(f" {w}" for w in short)], [*three.values(), *short.values()]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sums, pa.int64())], names=["gram", "n"])

        release()
        words: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text"):
                words.update((text.as_py() or "").lower().split())
                if len(words) >= flush:
                    yield rows()
        if words:
            yield rows()

    found = docs.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return char_model({r.gram: r.n for r in found if r.gram[0] != " "}, {r.gram[1:]: r.n for r in found if r.gram[0] == " "})


def fit(rows: list[tuple[str, int]], chars: CharModel | None = None) -> Model:
    """From (text, toxic).  A group of near copies counts once, by its share of toxic ones, so that copies don't make their words evidence.

    Without a character model, that of the rows' own words."""
    rows = sorted({t: y for t, y in sorted(rows)}.items())
    plain = Counter(b for t, _ in rows for own in set(t.lower().split()) if (b := own.strip(_EDGE)) and not disguised(b))
    known = frozenset(w for w, n in plain.items() if n >= 3 and (len(w) >= OUTER or _DOUBLE.search(w)))
    chars = chars or char_model(*counted(Counter(w for t, _ in rows for w in t.lower().split())))
    del plain
    base = sum(y for _, y in rows) / max(1, len(rows))
    restorer = Model(chars, {}, base)
    memo: dict[str, tuple[str, ...]] = {}

    def features(text: str, among: set[str] | None = None) -> set[str]:
        tokens, words = restorer.tokens.of(text), []
        for at, t in enumerate(tokens):
            if not disguised(t):
                read = (t,)
            elif (read := memo.get(t)) is None:
                read = tuple(restorer.likeliest(t))
                if len(memo) < restorer.most and len(t) <= 64:
                    memo[t] = read
            words.extend((at, t, word) for word in read)
        own = {w for _, _, w in words}
        return (own if among is None else own & among) | _recurring(words, tokens, among)

    may = Counter(f for t, y in rows if y for f in features(t))
    candidates = {f for f, n in may.items() if n >= 5}
    del may
    groups: dict[int, list[int]] = {}
    for i, family in enumerate(families([t for t, _ in rows])):
        groups.setdefault(family, []).append(i)
    all_count, toxic_count = Counter(), Counter()
    for members in groups.values():
        held, toxic = Counter(), Counter()
        for i in members:
            own = features(rows[i][0], candidates)
            held.update(own)
            if rows[i][1]:
                toxic.update(own)
        all_count.update(held.keys())
        for f, n in toxic.items():
            toxic_count[f] += n / held[f]
    weight = {f: w for f, n in toxic_count.items() if n >= 5 and (w := _bound(n, all_count[f])) > base + 0.15}
    weight = _unexplained(weight)
    # Words that hold a toxic one inside, or are one with a letter doubled, need restoring however often they were seen.
    restored = Model(chars, weight, 0.0)
    known = frozenset(w for w in known if restored.of(w)[0] or len(restored.readings(w)) > 1)
    chars.memo.clear()
    return Model(chars, weight, min(base, 0.5), known)


def fitted(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> Model:
    """The model of a bounded sample of labelled documents, collected to the driver, and of all documents' characters."""
    rows = sampled(docs, labels, "toxic", fit_docs, fit_chars)
    return fit([(t, int(y == 1)) for t, y in rows], corpus_chars(docs))


def scored(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    def make():
        def f(keys, texts):
            return [keys, [model.score(t.decode()) for t in texts]]

        return f

    return map_texts(docs, [key, "text"], SCHEMA.replace("doc_id", key), make)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those scoring threshold or more; all columns stay, in place, without a shuffle."""
    import pyarrow as pa

    light_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            keep = pa.array([model.score(t or "") < threshold for t in texts], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(run, docs.schema)


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fitted(docs, labels.where(~held_out(3, 1)))
    return scored(docs, model).select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
