"""License scans by ordered signature rules (native).

Texts are reduced to lower-cased words.  Each rule of :mod:`.license_rules` is gated by a keyword: where a text holds the word, the
words around it are cut out, REACH to either side, and the keyword's rules are matched against that window, each match holding
the keyword at its place.  So no rule runs over a whole text, and every place of a keyword is tried.

Overlapping detections are resolved within a document in order of priority, longer ones first among equals, then from the
left: a detection stays if it neither overlaps one that stays nor is contained in it.  Detections further apart than any match
is long can't meet, so they are resolved in groups.  Base phrases are found by the same way, are all reported and suppress nothing.

A document is scanned, resolved and summed up in its own row: no shuffle, no join, and its lists are as long as its text at most.

Defined cases: null or empty text has no words and no labels; repeated rows are scanned each; very long texts are whole; detections
alike in priority, length and place are one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import license_rules
from .license_rules import BASE, Rule  # noqa: F401  BASE belongs to this module's interface

#: Words of a window on either side of the keyword; no signature reaches as far.
REACH = 32
_MARK = "\x01"
_SPAN = "struct<prio:int,shorter:int,start:int,stop:int,label:string,confidence:double>"


def rules() -> list[dict]:
    """All rules as plain values, best priority first: base phrases, then the signatures.

    regex is over words between single blanks; cue and kw are the gate, the keyword between blanks."""
    out = []
    for r in license_rules.rules():
        gate, regex = f" {r.keyword} ", f"(?<![^ ])(?:{r.regex.replace('@', '')})(?![^ ])"
        out.append(r._asdict() | {"cue": gate, "kw": gate, "regex": regex})
    return out


def words_of(text: Column) -> Column:
    """Lower-cased words.  ``lower`` makes an ASCII letter of the Kelvin sign alone, which is put aside."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00b7"))
    return F.array_remove(F.split(F.lower(plain), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def expression(rule: Rule) -> str:
    """The rule's Java expression over a window, in which the keyword carries a mark."""
    return f"(?<![^ ])(?:{rule.regex.replace('@', _MARK)})(?![^ ])"


def _blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _window(w: Column, i: Column) -> Column:
    left = F.slice(w, F.greatest(i - REACH, F.lit(0)) + 1, F.least(i, F.lit(REACH)))
    right = F.slice(w, i + 1, F.lit(REACH + 1))
    return F.concat(F.lit(" "), F.array_join(left, " "), F.lit(f" {_MARK}"), F.array_join(right, " "), F.lit(" "))


def _spans(w: Column, i: Column, by_keyword: dict[str, list[Rule]]) -> Column:
    """Detections at the keyword in place i."""

    def matched(x: Column) -> Column:
        out = F
        for keyword, own in by_keyword.items():
            tried = [(F.regexp_extract(x["s"], expression(r), 0), F.lit(r.prio), F.lit(r.label), F.lit(r.confidence)) for r in own]
            found = F.array(*[F.struct(m.alias("m"), p.alias("prio"), n.alias("label"), c.alias("confidence")) for m, p, n, c in tried])
            out = out.when(x["k"] == keyword, F.filter(found, lambda y: y["m"] != ""))
        return out

    def span(x: Column) -> Column:
        size = _blanks(x["m"])
        start = i - _blanks(F.substring_index(x["m"], _MARK, 1))
        return F.struct(
            x["prio"].alias("prio"), (-size).alias("shorter"), start.alias("start"), (start + size).alias("stop"), x["label"].alias("label"), x["confidence"].alias("confidence")
        )

    at = F.array(F.struct(F.get(w, i).alias("k"), _window(w, i).alias("s")))
    return F.transform(F.flatten(F.transform(at, matched)), span)


def detections(w: Column, some: list[Rule]) -> Column:
    """Sorted spans (stop is the last word) of the rules' matches in a column of words."""
    by_keyword: dict[str, list[Rule]] = {}
    for r in some:
        by_keyword.setdefault(r.keyword, []).append(r)
    places = F.filter(F.transform(w, lambda x, i: F.when(x.isin(*by_keyword), i)), lambda i: i.isNotNull())
    found = F.array_sort(F.array_distinct(F.flatten(F.transform(places, lambda i: _spans(w, i, by_keyword)))))
    return F.when(F.arrays_overlap(w, F.array(*map(F.lit, by_keyword))), found).otherwise(F.array()).cast(f"array<{_SPAN}>")


def resolved(spans: Column) -> Column:
    """The spans that stay, of spans in order of priority, length and place."""
    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x.alias("x"))))
    # By start, spans that lie further apart than the longest possible match part the groups.
    first = lambda m: F.filter(
        F.transform(m, lambda x, i: F.when((i == 0) | (x["start"] - F.get(m, i - 1)["start"] > 2 * REACH + 1), i)), lambda i: i.isNotNull()
    )

    def stay(group: Column) -> Column:
        free = lambda kept, x: ~F.exists(kept, lambda y: (y["start"] <= x["stop"]) & (x["start"] <= y["stop"]))
        none = F.array().cast(f"array<{_SPAN}>")
        return F.aggregate(F.array_sort(F.transform(group, lambda g: g["x"])), none, lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))

    def groups(m: Column) -> Column:
        bounds = F.transform(F.array(first(m)), lambda b: F.transform(b, lambda at, j: F.slice(m, at + 1, F.coalesce(F.get(b, j + 1), F.size(m)) - at)))
        return F.flatten(F.transform(F.flatten(bounds), stay))

    return F.flatten(F.transform(F.array(by_start), groups))


def _once(df: DataFrame, name: str, made: Column) -> DataFrame:
    """Adds a column.  The generator keeps the optimizer from repeating it in each expression that uses it."""
    return df.select("*", F.explode(F.array(made)).alias(name))


def scanned(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, base places and labels, labels, score, and the base and remaining detections."""
    every = license_rules.rules()
    df = _once(docs.select("doc_id", "text"), "w", words_of(F.col("text"))).drop("text")
    df = _once(df, "found", detections(F.col("w"), every))
    df = df.select("doc_id", F.size("w").cast("long").alias("n_words"), "found")
    n_base = sum(r.base for r in every)
    df = df.withColumn("base", F.filter("found", lambda x: x["prio"] < n_base))
    df = _once(df, "kept", resolved(F.filter(F.col("found"), lambda x: x["prio"] >= n_base)))
    starts, both = F.transform("base", lambda x: x["start"].cast("long")), F.concat("base", "kept")
    labels = lambda spans: F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"])))
    return df.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(both).alias("labels"),
        F.coalesce(F.array_max(F.transform(both, lambda x: x["confidence"])), F.lit(0.0)).alias("score"),
        "base",
        "kept",
    )


def op8(docs: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(c, ",").alias(c)
    return scanned(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score")


_W = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: Base columns of op8 (the method's labels and score aren't SQL).
BASE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_W} AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (
  SELECT r, i - 1 AS place, 'mit' AS label FROM p WHERE w[i : i + 3] = ['under', 'the', 'mit', 'license']
  UNION ALL SELECT r, i - 1, 'apache-2' FROM p WHERE w[i : i + 3] = ['apache', 'license', 'version', '2']
  UNION ALL SELECT r, i - 1, 'cc-by-nc' FROM p WHERE w[i : i + 2] = ['cc', 'by', 'nc']
),
g AS (
  SELECT r, count(*) AS n, min(place) AS first, max(place) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first AS first_word, last AS last_word, coalesce(labels, '') AS base_labels
FROM d LEFT JOIN g ON d.r = g.r
"""
