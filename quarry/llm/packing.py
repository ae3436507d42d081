"""Packing documents into sequences by shortest-pack-first over the histogram of lengths.

Pass 1 tokenizes whole texts and cuts each document at multiples of the sequence length; it keeps
only (document, start, length, crc), a few bytes a piece.  The histogram has at most max_len rows,
so the packing itself is a driver loop over lengths whose cost doesn't grow with the corpus: longest
length first, each count goes to the open patterns with the most room left, splitting a pattern's
count where fewer are needed.  Pieces then find their place by rank within their length: rank r of a
length falls in one (pattern, copy, slot) interval.  The interval table has a proven bound: each
length splits one pattern's count and opens one at most, so there are at most 2 * max_len patterns,
each of at most sqrt(2 * max_len) distinct lengths.

Defined cases: null or empty text has the end id alone; repeated rows are packed each; texts of any
length are whole; pieces alike in length, document, start and ids are ties that no column tells apart; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, gapless_rank, held, map_texts, written

END_ID = 2
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def _byte_letters() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_BYTES = _byte_letters()


#: The tokenizer's pattern over the UTF-8 bytes of a lower-cased chunk, where all beyond ASCII are letters.
_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")
_SHORT = re.compile(rb"'(?:[stmd]|re|ve|ll)")
#: By byte: a letter 0, a digit 1, a sign 2.
_KIND = np.array([0 if b >= 128 or chr(b).isalpha() else 1 if chr(b).isdigit() else 2 for b in range(256)], dtype=np.int8)
#: bytes.translate table: A-Z lower-cased, white space a blank.
_CHUNKS = bytes(ord(" ") if chr(b) in SPACES else b + 32 if 65 <= b <= 90 else b for b in range(256))
_ASCII = bytes(range(128))


class Merges:
    """The model's merges, done on many short chunks at once.

    Each round does the next merge of every chunk that has one: the pair of least rank, the leftmost of these, as the tokenizer
    does one by one.  Chunks are columns, tokens rows; a pair's key is its rank and row, so a column's least key names its merge.
    Where a piece of the tokenizer's pattern ends, the token is one that ends a word, and no merge goes on from such a token.
    """

    WIDTHS = (5, 7, 9, 12, 16, 24)  # bytes of a chunk; longer ones go to the tokenizer's model
    FEW = 64  # chunks for which the model is faster
    WORDS = 4096  # at a time: the tables stay in the processor's cache
    NONE = 1 << 30

    def __init__(self, tokenizer):
        self.model = tokenizer.model
        given = json.loads(tokenizer.to_str())["model"]
        if not given.get("end_of_word_suffix"):
            raise ValueError("the tokenizer doesn't mark the ends of words")
        ids, suffix = given["vocab"], given["end_of_word_suffix"]
        self.pad = max(ids.values()) + 1
        self.kind = np.uint16 if self.pad < 65535 else np.int32
        self.inner = np.array([ids[c] for c in _BYTES], dtype=self.kind)
        self.last = np.array([ids[c + suffix] for c in _BYTES], dtype=self.kind)
        merges = [m.split(" ") if isinstance(m, str) else m for m in given["merges"]]
        if len(merges) << 5 >= self.NONE >> 1:
            raise ValueError("the tokenizer has too many merges")
        if any(x.endswith(suffix) for x, _ in merges):
            raise ValueError("the tokenizer merges beyond the ends of words")
        self.made = np.array([*(ids[x + y] for x, y in merges), self.pad], dtype=self.kind)
        rights: dict[int, dict[int, int]] = {}
        for rank, (x, y) in enumerate(merges):
            rights.setdefault(ids[x], {})[ids[y]] = rank
        # A pair's place is its left token's shift plus its right token; shifts are such that no two pairs share a place.
        room = self.pad + (1 << (4 * len(merges)).bit_length())
        self.shift = np.zeros(self.pad + 1, dtype=np.int32)
        self.left = np.full(room + self.pad + 1, free := self.pad + 1, dtype=self.kind)
        self.key = np.full(room + self.pad + 1, self.NONE, dtype=np.int32)
        rng = np.random.default_rng(0)
        for left, ranks in sorted(rights.items(), key=lambda x: -len(x[1])):
            right = np.array(list(ranks), dtype=np.int32)
            while (self.left[(shift := int(rng.integers(room))) + right] != free).any():
                pass
            self.shift[left] = shift
            self.left[self.shift[left] + right] = left
            self.key[self.shift[left] + right] = np.array(list(ranks.values())) << 5
        # Pairs of bytes, the second of them inside or at the end of a piece.
        self.first = self.keys(np.repeat(self.inner, 512), np.tile(np.append(self.inner, self.last), 256))

    def keys(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 5 of each pair, NONE if it doesn't merge."""
        at = self.shift[left] + right
        return np.where(self.left[at] == left, self.key[at], self.NONE)

    def of_width(self, chunks: list[bytes], width: int) -> list[bytes]:
        n = len(chunks)
        lengths = np.fromiter(map(len, chunks), dtype=np.int64, count=n)
        letters = np.ascontiguousarray(np.array(chunks, dtype=f"S{width}").view(np.uint8).reshape(n, width).T)
        rows = np.arange(width + 3, dtype=np.int32)[:, None]
        columns = np.arange(n)
        kinds = _KIND[letters]
        ends = kinds == 1
        ends[:-1] |= kinds[:-1] != kinds[1:]
        ends[lengths - 1, columns] = True
        # The first row and all after a chunk's end are padding.  Keys of row i are those of its token and the next.
        tokens = np.full((width + 3, n), self.pad, dtype=self.kind)
        tokens[1:-2] = np.where(rows[1:-2] > lengths, self.kind(self.pad), np.where(ends, self.last[letters], self.inner[letters]))
        keys = np.full((width + 2, n), self.NONE, dtype=np.int32)
        pairs = letters[:-1].astype(np.int32) << 9 | ends[1:].astype(np.int32) << 8 | letters[1:]
        keys[1:-2] = np.where(ends[:-1] | (rows[1:-3] >= lengths), self.NONE, self.first[pairs] + rows[1:-3])
        out = np.empty((n, width), dtype="<u4")
        todo = columns
        while True:
            best = keys.min(axis=0)
            go = best < self.NONE >> 1  # keys of none change by rows
            going = int(np.count_nonzero(go))
            if going < 0.7 * len(todo) or not going:
                done, go = np.flatnonzero(~go), np.flatnonzero(go)
                out[todo[done]] = tokens[1:-2].take(done, axis=1).T
                if not going:
                    break
                todo, best = todo[go], best[go]
                tokens, keys, columns = tokens.take(go, axis=1), keys.take(go, axis=1), columns[:going]
                at, made = best & 31, self.made[best >> 5]
            else:  # chunks without a merge put padding on their last row
                at, made = np.where(go, best & 31, width + 1), self.made[np.where(go, best >> 5, -1)]
            after = rows > at
            tokens[:-1] = np.where(after[:-1], tokens[1:], tokens[:-1])
            keys[:-1] = np.where(after[:-2], keys[1:] - 1, keys[:-1])
            tokens[at, columns] = made
            keys[at, columns] = self.keys(made, tokens[at + 1, columns]) + at
            keys[at - 1, columns] = self.keys(tokens[at - 1, columns], made) + (at - 1)
        raw, row = out.tobytes(), 4 * width
        ends = (np.arange(n) * row + 4 * (out != self.pad).sum(axis=1)).tolist()
        return [raw[a:b] for a, b in zip(range(0, n * row, row), ends)]

    def one(self, chunk: bytes) -> bytes:
        tokens = [t for p in _PIECE.findall(chunk) for t in self.model.tokenize("".join([_BYTES[b] for b in p]))]
        return np.array([t.id for t in tokens], dtype="<u4").tobytes()

    def into(self, out: dict[bytes, bytes], chunks: list[bytes]) -> None:
        """Puts each chunk's ids into out.  Chunks are lower-case and not empty, without white space; all beyond ASCII are normal letters."""
        odd = [c for c in chunks if 39 in c and _SHORT.search(c)]  # 39: the apostrophe; looking for bytes is slower
        if odd:
            out.update([(c, self.one(c)) for c in odd])
            chunks = set(chunks).difference(odd)
        chunks = sorted(chunks, key=len)
        at = 0
        for width in self.WIDTHS:
            end = bisect_right(chunks, width, key=len)
            if end - at >= self.FEW:  # else they count with the next width's
                for start in range(at, end, self.WORDS):
                    part = chunks[start : min(end, start + self.WORDS)]
                    out.update(zip(part, self.of_width(part, width)))
                at = end
        out.update([(c, self.one(c)) for c in chunks[at:]])


class Encoder:
    """Ids of a text as little-endian 32-bit bytes, with a bounded cache of blank-separated chunks.

    The tokenizer lower-cases and drops white space before it forms tokens, so no token crosses a blank or newline,
    and a text's ids are its lower-cased chunks' ids in order.  Chunks whose only characters beyond ASCII are normal
    lower-case letters go to the merges here.  All else takes the tokenizer's full path, and so do whole texts that may
    hold the name of a special token, in which case matters.

    The cache has two halves.  When the newer one is full it becomes the older, and chunks met again move back: frequent ones stay.
    """

    def __init__(self, tokenizer_path: str, cache_chunks: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.merges = Merges(self.tokenizer)
        self.cache: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}
        self.half = cache_chunks // 2

    def full(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in got]

    @staticmethod
    def plain(chunk: bytes) -> bool:
        """Whether a chunk that is not ASCII has normal lower-case letters alone beyond it."""
        text = chunk.decode()
        if text != text.lower() or not unicodedata.is_normalized("NFC", text):
            return False
        return text.isalpha() or chunk.translate(None, _ASCII).decode().isalpha()

    def learn(self, missing: list[bytes]) -> None:
        rest = [c for c in missing if not c.isascii() and not self.plain(c)]
        if rest:
            self.cache.update(zip(rest, self.full([c.decode() for c in rest])))
            missing = set(missing).difference(rest)
        self.merges.into(self.cache, missing)

    def batch(self, texts: list[bytes]) -> Iterator[bytes]:
        """A few hundred texts' chunks are looked up together, so that unseen ones are encoded at once."""
        for at in range(0, len(texts), 200):
            part = texts[at : at + 200]
            split = [t.translate(_CHUNKS).split(b" ") for t in part]
            seen = set().union(*split)
            unseen = seen.difference(self.cache)
            if len(self.cache) + len(unseen) > self.half:
                self.older, self.cache = self.cache, {b"": b""}
                unseen = seen
            missing = []
            for chunk in unseen:
                if (known := self.older.get(chunk)) is None:
                    missing.append(chunk)
                else:
                    self.cache[chunk] = known
            if missing:
                self.learn(missing)
            get = self.cache.__getitem__
            for text, chunks in zip(part, split):
                yield self.full([text.decode()])[0] if b"<|" in text else b"".join(map(get, chunks))


def encoder(path: str) -> Encoder:
    return held(f"encoder {path}", lambda: Encoder(path))


def cut(docs: DataFrame, tokenizer_path: str, max_len: int, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def make():
        enc = encoder(tokenizer_path)

        def f(doc_ids, texts):
            ids, starts, lengths, crcs, totals = out = ([], [], [], [], [])
            for doc_id, got in zip(doc_ids, enc.batch(texts)):
                got += end
                n = len(got) // 4
                for start in range(0, n, max_len):
                    piece = memoryview(got)[4 * start : 4 * (start + max_len)]
                    ids.append(doc_id)
                    starts.append(start)
                    lengths.append(len(piece) // 4)
                    crcs.append(zlib.crc32(piece))
                    totals.append(n)
            return out

        return f

    return map_texts(docs, ["doc_id", "text"], PIECES, make)


def shortest_pack_first(histogram: dict[int, int], max_len: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns as (copies, [(length, times), ...]), lengths descending."""
    room: dict[int, list[tuple[int, tuple]]] = {}  # free tokens -> (copies, pattern) with that room
    free: list[int] = []  # keys of room, ascending

    def put(left: int, copies: int, pattern: tuple) -> None:
        if left not in room:
            room[left] = []
            insort(free, left)
        room[left].append((copies, pattern))

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            if free and free[-1] >= length:
                left = free[-1]
                copies, pattern = room[left].pop()
                if not room[left]:
                    del room[left]
                    free.pop()
                # Full use of a pattern may take the length several times before another pattern has more room.
                used = min(copies, todo)
                if used < copies:
                    put(left, copies - used, pattern)
                if pattern and pattern[-1][0] == length:
                    grown = (*pattern[:-1], (length, pattern[-1][1] + 1))
                else:
                    grown = (*pattern, (length, 1))
                put(left - length, used, grown)
                todo -= used
            else:
                times = min(max_len // length, todo)
                copies = todo // times if times else 0
                put(max_len - length * times, copies, ((length, times),))
                todo -= copies * times
    return [(copies, list(pattern)) for at in room.values() for copies, pattern in at]


def _intervals(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (key, length, times, first sequence, offset), sorted; key is length << 40 | first rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for copies, pattern in patterns:
        offset = 0
        for length, times in pattern:
            rank = used.get(length, 0)
            rows.append((length << 40 | rank, length, times, sequence, offset))
            used[length] = rank + copies * times
            offset += length * times
        sequence += copies
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = 4096, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = written(cut(docs, tokenizer_path, max_len, end_id), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}  # max_len rows at most
    table = _intervals(shortest_pack_first(histogram, max_len))
    ranked = gapless_rank(pieces, "length", ["doc_id", "start", "ids_crc32"], "_rank")
    schema = f"{PIECES}, sequence_id long, offset long".replace("length int", "length long")

    def place(batches):
        keys, lengths, times, first, offset = table.T
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("_rank").to_numpy().astype(np.int64)
            at = np.searchsorted(keys, (length << 40) | rank, side="right") - 1
            nth = rank - (keys[at] & ((1 << 40) - 1))
            cols = [batch.column(c) for c in ("doc_id", "start")] + [pa.array(length)]
            cols += [batch.column(c) for c in ("ids_crc32", "doc_tokens")]
            cols += [pa.array(first[at] + nth // times[at]), pa.array(offset[at] + nth % times[at] * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    return ranked.mapInArrow(place, schema)


def op2(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return pack(docs, tokenizer_path)
