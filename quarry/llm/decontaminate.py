"""Benchmark decontamination with a distributed positional inverted index.

The index is document-partitioned, so building it moves no row between tasks, and it is built once for any benchmark: each row
is a block of whole documents with its terms, their bounds and their positions over the block's words, with a gap between
documents.  A search sends windows to all blocks.  Windows with a term that the block lacks end at one look at their row of term
numbers.  Of the others, the postings of each one's rarest term, shifted by that term's offset, are intersected with the next
rarest's, and so on, for all windows of a chunk at once.  With slop 0 what is left are exact phrases; with a larger slop
each term may stand so many words off its place (proximity).

The benchmark's side is broadcast in chunks of at most MAX_WINDOWS distinct windows, cut within an item too; each chunk
searches the same written index, whose rows name documents by (block, ordinal), and a document's spans from all chunks are united.

Defined cases: null or wordless texts have no words and no hits, and a wordless item has no window; repeated rows
keep a row each; very long documents are whole, in a block of their own; equal item ids count once, a
null item id marks words but isn't counted; an empty benchmark hits nothing; an empty documents table gives an empty result; equally
rare terms of a window are taken from the left; extra columns are ignored by :func:`matches` and kept by :func:`clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, fresh, light_batches, release, scratch, slices, small, text_hash, written

MAX_WINDOWS = 1_000_000
#: A block's arrays stay below half a megabyte, unless one document is longer: larger objects fragment an executor's heap.
BLOCK_WORDS, BLOCK_DOCS = 1 << 16, 4096
#: Places that are followed at a time while lists are intersected; one window's own list may be longer.
PLACES = 1 << 19
INDEX = "block long, doc_ids array<long>, n_words array<int>, terms binary, sizes binary, positions binary"
HITS = "block long, ordinal int, doc_id long, n_words long, spans array<struct<start:long,stop:long>>, items array<long>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def words(text: bytes) -> list[bytes]:
    """Runs of 0-9, a-z (A-Z lower-cased) and everything outside ASCII."""
    return text.translate(WORD_BYTES).split()


class Numbers(dict):
    """Numbers keys from 0 as they are first asked for."""

    def __missing__(self, key):
        self[key] = got = len(self)
        return got


class Windows:
    """Distinct windows of a chunk of items, as tuples of term numbers, with the items that hold them."""

    def __init__(self):
        self.vocabulary = Numbers()
        self.items: dict[tuple[int, ...], set[int]] = {}

    def by_width(self) -> list[tuple[np.ndarray, list[list[int]]]]:
        """(term numbers, a row a window; their owners) for each number of words."""
        groups: dict[int, list] = {}
        for window in self.items:
            groups.setdefault(len(window), []).append(window)
        return [(np.array(own, dtype=np.int32), [sorted(self.items[w]) for w in own]) for own in groups.values()]


def chunks_of(benchmark: DataFrame, width: int, most: int) -> Iterator[Windows]:
    """Chunks of at most so many distinct windows; at least one chunk."""
    chunk, any_chunk = Windows(), False
    for row in benchmark.select("item_id", "text").toLocalIterator():
        own = words((row.text or "").encode())
        for at in range(max(1, len(own) - width + 1)) if own else ():
            if len(chunk.items) >= most:
                yield chunk
                chunk, any_chunk = Windows(), True
            owners = chunk.items.setdefault(tuple(map(chunk.vocabulary.__getitem__, own[at : at + width])), set())
            if row.item_id is not None:
                owners.add(row.item_id)
    if chunk.items or not any_chunk:
        yield chunk


def whole(length: int) -> type:
    """The type of the positions and list sizes of a block of so many words and gaps; a gap at least is no word."""
    return np.uint16 if length <= 1 << 16 else np.int32 if length < 1 << 31 else np.int64


def build_index(docs: DataFrame) -> DataFrame:
    """Blocks of documents with the postings of all their terms; terms are parted by blanks, which no word holds."""

    def run(batches):
        from pyspark import TaskContext

        release()
        ids, counts, found, at, numbers = [], [], [], 0, Numbers()
        block = TaskContext.get().partitionId() << 32

        def row():
            nonlocal ids, counts, found, at, numbers, block
            term = np.concatenate(found)
            place = np.flatnonzero(term >= 0)
            term = term[place]
            order = np.argsort(term, kind="stable")
            lists = [x.astype(whole(at)).tobytes() for x in (np.bincount(term, minlength=len(numbers)), place[order])]
            data = [[block], [ids], [counts], [b" ".join(numbers)], *([x] for x in lists)]
            ids, counts, found, at, numbers, block = [], [], [], 0, Numbers(), block + 1
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
            names = ["block", "doc_ids", "n_words", "terms", "sizes", "positions"]
            return pa.RecordBatch.from_arrays([pa.array(d, type=t) for d, t in zip(data, types)], names=names)

        for batch in slices(batches):
            texts = batch.column("text").cast(pa.large_binary())
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                own = words(text.as_py() or b"")
                if ids and (at + len(own) >= BLOCK_WORDS or len(ids) >= BLOCK_DOCS):
                    yield row()
                terms = np.empty(len(own) + 1, dtype=np.int32)
                terms[:-1] = np.fromiter(map(numbers.__getitem__, own), dtype=np.int32, count=len(own))
                terms[-1] = -1  # the gap
                ids.append(doc_id)
                counts.append(len(own))
                found.append(terms)
                at += len(terms)
        if ids:
            yield row()

    light_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, INDEX)


class Block:
    """The postings of one block, numbered by a benchmark's vocabulary."""

    def __init__(self, terms: bytes, bounds: np.ndarray, positions: np.ndarray, length: int, vocabulary: dict[bytes, int]):
        self.bounds, self.positions, self.size = bounds, positions, np.diff(bounds)
        self.of = np.full(len(vocabulary) + 1, -1, dtype=np.int32)
        for number, term in enumerate(terms.split()):
            if (known := vocabulary.get(term)) is not None:
                self.of[known] = number
        self.at = np.full(length, -1, dtype=np.int32)  # the lists by position
        self.at[positions] = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)

    def near(self, terms: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
        """Which wanted places have a posting of their term within slop."""
        out = np.zeros(len(wanted), dtype=bool)
        for off in range(-slop, slop + 1):
            place = wanted + off
            inside = (place >= 0) & (place < len(self.at))
            out[inside] |= self.at[place[inside]] == terms[inside]
        return out

    def search(self, windows: np.ndarray, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of the window, start) of occurrences, in parts."""
        if not len(windows):
            return
        own = self.of[windows]
        rows = np.flatnonzero((own >= 0).all(axis=1))
        own = own[rows]
        order = np.argsort(self.size[own], axis=1, kind="stable")
        first = own[np.arange(len(own)), order[:, 0]] if len(own) else np.empty(0, np.int32)
        sizes = self.size[first]
        upto = np.cumsum(sizes)
        a = 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] - sizes[a] + PLACES, side="right")))
            n = sizes[a:b]
            window = np.repeat(np.arange(a, b), n)
            nth = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
            starts = self.positions[self.bounds[first[window]] + nth].astype(np.int64) - order[window, 0]
            for i in range(1, windows.shape[1]):
                off = order[window, i]
                keep = self.near(own[window, off], starts + off, slop)
                window, starts = window[keep], starts[keep]
                if not len(starts):
                    break
            if len(starts):
                yield rows[window], starts
            a = b


def search(index: DataFrame, chunk: Windows, slop: int = 0) -> DataFrame:
    """One row a document: its merged spans of hit words and the items that have a window there."""
    groups, vocabulary = chunk.by_width(), dict(chunk.vocabulary)

    def found(r: dict) -> tuple[np.ndarray, list, list]:
        counts = np.array(r["n_words"], dtype=np.int64)
        base = np.concatenate(([0], np.cumsum(counts + 1)))
        sizes, positions = (np.frombuffer(r[c], dtype=whole(int(base[-1]))) for c in ("sizes", "positions"))
        bounds = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        block = Block(r["terms"], bounds, positions, int(base[-1]), vocabulary)
        step = np.zeros(base[-1] + 1, dtype=np.int32)
        items: dict[int, set[int]] = {}
        for windows, owners in groups:
            for window, starts in block.search(windows, slop):
                stops = starts + windows.shape[1]
                doc = np.searchsorted(base, starts, side="right") - 1
                inside = (starts >= 0) & (stops <= base[doc] + counts[doc])  # slop may reach over a document's end
                window, starts, stops, doc = window[inside], starts[inside], stops[inside], doc[inside]
                np.add.at(step, starts, 1)
                np.add.at(step, stops, -1)
                for d, w in np.unique(np.stack([doc, window], axis=1), axis=0).tolist():
                    items.setdefault(d, set()).update(owners[w])
        covered = np.diff((np.cumsum(step) > 0).astype(np.int8), prepend=0)
        first, last = np.nonzero(covered == 1)[0], np.nonzero(covered == -1)[0]
        of = np.searchsorted(base, first, side="right") - 1
        spans: dict[int, list] = {}
        for d, a, b in zip(of.tolist(), first.tolist(), last.tolist()):
            spans.setdefault(d, []).append({"start": a - int(base[d]), "stop": b - int(base[d])})
        n = len(counts)
        return counts, [spans.get(d, []) for d in range(n)], [sorted(items.get(d, ())) for d in range(n)]

    def run(batches):
        release()
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                counts, spans, items = found(r)
                n = len(counts)
                columns = [
                    pa.array([r["block"]] * n, pa.int64()),
                    pa.array(range(n), pa.int32()),
                    pa.array(r["doc_ids"], pa.int64()),
                    pa.array(counts),
                    pa.array(spans, _SPANS),
                    pa.array(items, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "ordinal", "doc_id", "n_words", "spans", "items"])

    return index.mapInArrow(run, HITS)


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 0) -> DataFrame:
    """One row a document: doc_id, n_words, spans (merged, from word 0, stop exclusive) and sorted items."""
    index = written(build_index(docs), "postings")
    chunks = chunks_of(benchmark, width, MAX_WINDOWS)
    found, following = search(index, next(chunks), slop), next(chunks, None)
    if following is not None:
        # Each chunk's result is written before the next chunk is read, so the driver holds one chunk, and the one after it.
        found = written(found, "hits")
        while following is not None:
            found = found.unionAll(written(search(index, following, slop).where(F.size("spans") > 0), "hits"))
            following = next(chunks, None)
        found = found.groupBy("block", "ordinal", "doc_id", "n_words").agg(
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    return found.select("doc_id", "n_words", F.sort_array("spans").alias("spans"), "items")


def hit_words(spans) -> F.Column:
    """Words in the union of sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))

    def step(acc, s):
        return F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(s["start"], acc["upto"]))).alias("n"),
            F.greatest(acc["upto"], s["stop"]).alias("upto"),
        )

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """docs without those that hold a window of the benchmark; all columns stay.

    Texts are searched under their hash, so rows of one id and different texts stay apart."""
    th, hit = fresh(docs, "_th", "_hit")
    by_hash = docs.select(text_hash(F.col("text")).alias("doc_id"), "text")
    with scratch(docs.sparkSession) as made:
        spotted = matches(by_hash, benchmark, width).where(F.size("spans") > 0)
        hits = made.keep(written(spotted.select(F.col("doc_id").alias(hit)).distinct(), "hits"))
    full = docs.withColumn(th, text_hash(F.col("text")))
    kept = full.join(small(hits, hits.count()), F.col(th) == F.col(hit), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return matches(docs, benchmark).select(
        "doc_id",
        "n_words",
        hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (hit_words(F.col("spans")) > 0).alias("contaminated"),
    )


_WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)
),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
