"""Near-duplicates by SimHash, linked through vantage-point trees.

Texts become 64-bit fingerprints; equal fingerprints are pre-aggregated, so a group of copies of any
size is one point.  A vantage-point tree over a bounded sample deals the distinct points to shards:
at each node a point goes inside (distance <= radius) or outside.  A pair within k bits that a node
parts has its outer point at distance radius + k at most, so copying the outer points of that
boundary band inside too keeps every pair together in one shard.  Inside a shard the same
recursion, pruned by the same bound, finds the pairs.  Where a ball is too dense for any bound to prune, its bits are cut into
k + 1 blocks: two points within k bits agree in a whole block, so the ball is dealt by blocks' values, to other shards and
again inside one, until what is left is small; a breadth-first search then compares each point with those not reached yet.
Shards return star edges (point, least point of its part); label propagation with pointer jumping joins them.

Defined cases: null, empty or blank text has fingerprint 0 and is linked like any other; with fewer
words than the shingle width the whole sequence is one shingle; a component whose doc_ids are all
null has a null id; repeated rows keep a row each; an empty table gives an empty result; extra columns are ignored
by :func:`components` and kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, fresh, map_texts, scratch, small, text_hash, written

SEED = 42
#: Points of a shard and of the sample per shard.  One shard of this size takes about 100 MB and seconds.
POINTS_A_SHARD, SAMPLE_A_SHARD, LEAST_SHARDS = 1_000_000, 128, 32
#: Splits that leave more than this share on one side, among shards and within one, are none: their copies outgrow what they part.
#: Random points lie 32 +- 4 bits apart, and the better side of a split with 2 bits of overlap holds 0.6 of them.
WORST_DEAL, WORST_SPLIT = 0.75, 0.65
#: Points that are compared all with all, and points that a breadth-first search takes.
ALL_PAIRS, SEARCHED = 192, 2048


def shingle_digests(text: bytes, width: int) -> list[bytes]:
    """Big-endian XXH64 digests of a text's shingles, repeats included; fewer words: the whole sequence; none: none."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return []
    hashed, joined = xxhash.xxh64_digest, b" ".join(words)
    if n < width:
        return [hashed(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [hashed(joined[a:b], SEED) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())]


def majority(digests: list[bytes]) -> int:
    """64 bits as a signed integer: a bit is 1 if set in over half of the digests."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(digests), 1 << 16):
        part = digests[at : at + (1 << 16)]
        bits = np.unpackbits(np.frombuffer(b"".join(part), dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(digests)).view(">u8")[0].astype(np.uint64).astype(np.int64))


def fingerprint(text: bytes, width: int = 3) -> int:
    return majority(shingle_digests(text, width))


def fingerprints(docs: DataFrame, width: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept long columns and fp long."""
    def make():
        def f(*cols):
            return [*cols[:-1], [fingerprint(t, width) for t in cols[-1]]]

        return f

    return map_texts(docs, [*keep, "text"], ", ".join(f"{c} long" for c in (*keep, "fp")), make, True)


def _distance(points: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ point)


def _radius(d: np.ndarray, k: int) -> tuple[int, int]:
    """The radius whose larger side (inner with its band, outer) is least, and that side's size."""
    upto = np.cumsum(np.bincount(d, minlength=65 + k))
    inner, outer = upto[k : k + 65], len(d) - upto[:65]
    worst = np.maximum(inner, outer)
    r = int(np.argmin(worst))
    return r, int(worst[r])


def block_masks(points: np.ndarray, k: int) -> list[np.uint64]:
    """All 64 bits in k + 1 blocks, those in which the points differ dealt evenly."""
    varying = int(np.bitwise_or.reduce(points ^ points[0])) if len(points) else 0
    bits = sorted(range(64), key=lambda b: not varying >> b & 1)
    return [np.uint64(sum(1 << b for b in bits[i :: k + 1])) for i in range(k + 1)]


class Dense:
    """A leaf that no bound splits: number, block masks, and how many shards a block's values are dealt to."""

    def __init__(self, number: int, masks: list[np.uint64], shards: int):
        self.number, self.masks, self.shards = number, masks, shards


def build_tree(sample: np.ndarray, shards: int, k: int) -> list | int | Dense:
    """Nested [vantage point, radius, inside, outside]; leaves are numbered from 0."""
    rng, count = np.random.default_rng(7), [0]

    def grow(points: np.ndarray, want: int):
        if want > 1 and len(points) > 1:
            tries = rng.choice(points, size=min(8, len(points)), replace=False)
            best = min(((*_radius(_distance(points, p), k)[::-1], p) for p in tries), key=lambda x: x[:2])
            worst, r, p = best
            if worst <= WORST_DEAL * len(points):
                d = _distance(points, p)
                return [int(p), r, grow(points[d <= r + k], want // 2), grow(points[d > r], want - want // 2)]
        count[0] += 1
        number = count[0] - 1
        return number if want == 1 or len(points) < 8 else Dense(number, block_masks(points, k), want)

    return grow(sample, shards)


def deal(points: np.ndarray, tree: list | int | Dense, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, points) of every shard that a point must be in."""
    if not len(points):
        return
    if isinstance(tree, int):
        yield tree << 32, points
    elif isinstance(tree, Dense):
        for i, mask in enumerate(tree.masks):
            mixed = ((points & mask) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            place = (mixed % np.uint64(tree.shards)).astype(np.int64)
            for at in np.unique(place).tolist():
                yield tree.number << 32 | (i * tree.shards + at), points[place == at]
    else:
        p, r, inside, outside = tree
        d = _distance(points, np.uint64(p))
        yield from deal(points[d <= r + k], inside, k)
        yield from deal(points[d > r], outside, k)


def star_edges(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, least point of its connected part) of every point linked to another; points are distinct."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def link(a: int, b: int) -> None:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)

    def search(own: np.ndarray) -> None:
        """Breadth-first over what nothing splits."""
        rest = own
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                p = front.pop()
                near = _distance(rest, p) <= k
                if near.any():
                    found, rest = rest[near], rest[~near]
                    for q in found.tolist():
                        link(int(p), q)
                    front.extend(found)

    def by_blocks(own: np.ndarray) -> None:
        """Groups that agree in a block; those still large are cut again by the bits in which they differ."""
        if len(own) <= SEARCHED or int(np.bitwise_or.reduce(own ^ own[0])).bit_count() <= k + 1:
            search(own)
            return
        for mask in block_masks(own, k):
            key = own & mask
            order = np.argsort(key, kind="stable")
            key, at = key[order], own[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, len(at)))
            for i in np.flatnonzero(size > ALL_PAIRS).tolist():
                by_blocks(at[first[i] : first[i] + size[i]])
            few = np.repeat(size <= ALL_PAIRS, size)
            key, at = key[few], at[few]
            for off in range(1, ALL_PAIRS):
                same = key[off:] == key[:-off]
                if not same.any():
                    break
                x, y = at[:-off][same], at[off:][same]
                near = np.bitwise_count(x ^ y) <= k
                for a, b in zip(x[near].tolist(), y[near].tolist()):
                    link(a, b)

    stack = [points]
    rng = np.random.default_rng(11)
    while stack:
        own = stack.pop()
        if len(own) < 2:
            continue
        if len(own) <= ALL_PAIRS:
            a, b = np.nonzero(np.triu(np.bitwise_count(own[:, None] ^ own[None, :]) <= k, 1))
            if len(a) <= 4 * len(own):
                for x, y in zip(own[a].tolist(), own[b].tolist()):
                    link(x, y)
            else:
                search(own)
            continue
        tries = own[rng.integers(0, len(own), size=4)]
        worst, r, p = min(((*_radius(_distance(own, p), k)[::-1], p) for p in tries), key=lambda x: x[:2])
        if worst > WORST_SPLIT * len(own):
            by_blocks(own)
            continue
        d = _distance(own, p)
        stack += [own[d <= r + k], own[d > r]]
    nodes = np.array(list(parent), dtype=np.uint64)
    return nodes, np.array([find(x) for x in parent], dtype=np.uint64)


def linked_points(points: DataFrame, k: int = 2) -> DataFrame:
    """(fp, root) of distinct points that have a link; points is a written table of distinct fp."""
    n = points.count()
    shards = LEAST_SHARDS
    while shards * POINTS_A_SHARD < n:
        shards *= 2
    sampled = points.orderBy(F.xxhash64("fp")).limit(shards * SAMPLE_A_SHARD).collect()  # bounded by the shards' number
    tree = build_tree(np.array([r.fp for r in sampled], dtype=np.int64).view(np.uint64), shards, k)

    def to_shards(batches):
        for batch in batches:
            own = batch.column("fp").to_numpy().view(np.uint64)
            for shard, part in deal(own, tree, k):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), shard, dtype=np.int64)), pa.array(part.view(np.int64))], names=["shard", "fp"]
                )

    def edges(table: pa.Table) -> pa.Table:
        nodes, roots = star_edges(np.unique(table.column("fp").to_numpy().view(np.uint64)), k)
        return pa.table({"fp": nodes.view(np.int64), "root": roots.view(np.int64)})

    dealt = points.select("fp").mapInArrow(to_shards, "shard long, fp long")
    return dealt.groupBy("shard").applyInArrow(edges, "fp long, root long").where("fp != root")


def propagate(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected part, for a written table of edges (fp, root).

    Every round takes the least label among neighbours, then that label's own label; the number of
    rounds grows with the logarithm of the longest chain.  Both sides of each join come straight from
    written tables or an exchange, so AQE can split a node that has very many edges.
    """
    both = written(
        edges.select(F.col("fp").alias("node"), F.col("root").alias("other")).union(edges.select("root", "fp")).distinct(),
        "links",
    )
    labels = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("label").alias("seen"))
        least = both.join(seen, "other").groupBy("node").agg(F.min("seen").alias("seen"))
        jump = labels.select(F.col("node").alias("label2"), F.col("label").alias("jumped"))
        step = (
            labels.join(least, "node")
            .select("node", "label", F.least("label", "seen").alias("label2"))
            .join(jump, "label2", "left")
            .select("node", F.col("label").alias("was"), F.least("label2", "jumped").alias("label"))
        )
        after = written(step, "labels")
        moved = after.where("label != was").limit(1).count()
        drop_written(labels)
        labels = after
        if not moved:
            drop_written(both)
            return labels.select("node", "label")


def classes(fps: DataFrame, k: int = 2) -> DataFrame:
    """(fp, component_id) of every distinct fp of a written table (doc_id, fp): the least doc_id reachable."""
    points = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    labels = propagate(written(linked_points(points, k), "edges"))
    named = points.join(labels, points.fp == labels.node, "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label")
    )
    own = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return named.select("fp", "label").join(own, "label").select("fp", "component_id")


def components(docs: DataFrame, width: int = 3, k: int = 2) -> DataFrame:
    """doc_id, fp (signed), component_id, for every row."""
    with scratch(docs.sparkSession) as made:
        fps = made.keep(written(fingerprints(docs, width), "fingerprints"))
        of = made.keep(written(classes(fps, k), "classes"))
    return fps.join(of, "fp", "left").select("doc_id", "fp", "component_id")


#: Min-wise sketches: the share of equal minima estimates the similarity, with a standard error of 0.035 at 0.8.
MINIMA = 128
#: Below the first share a pair is not similar, from the second on it is; between them its shingles decide.  0.8 -+ 4 standard errors.
UNSURE = (0.66, 0.94)
#: Texts of a block of a bucket; blocks are compared two at a time.
BLOCK = 1024
_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(0, 1 << 63, size=MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, size=MINIMA, dtype=np.uint64)


def distinct(digests: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    return np.unique(np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The upper halves of the least value of each of MINIMA hash functions over a text's shingles."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[at : at + 2048, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def least_equal(similarity: float) -> int:
    """The least number of equal minima whose share is similarity or more."""
    return int(np.argmax(np.arange(MINIMA + 1) / MINIMA >= similarity))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct values; of two empty ones 1."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(len(b) == 0)
    both = int((b[np.minimum(b.searchsorted(a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def halves(digests: list[bytes]) -> bytes:
    """The sorted distinct upper halves of a text's shingle hashes."""
    return np.unique((distinct(digests) >> np.uint64(32)).astype(np.uint32)).tobytes()


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and th (text hash) of every row; fp and minima (binary) where a task meets a text first, null at its further rows."""

    def make():
        seen = set()

        def f(ids, hashes, texts):
            fps, all_minima = [], []
            for th, t in zip(hashes, texts):
                new = th not in seen
                seen.add(th)
                digests = shingle_digests(t, width) if new else []
                fps.append(majority(digests) if new else None)
                all_minima.append(minima(distinct(digests)).tobytes() if new else None)
            return [ids, hashes, fps, all_minima]

        return f

    return map_texts(docs, ["doc_id", "th", "text"], "doc_id long, th long, fp long, minima binary", make, True)


def _shingled(docs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(th, shingles: sorted distinct 32-bit hashes, binary), a row a text, of the given texts; written.

    Few texts need them, so they are made from docs when they do: those of all texts would be as large as the texts."""

    def make():
        seen = set()

        def f(hashes, texts):
            new = [i for i, th in enumerate(hashes) if not (th in seen or seen.add(th))]
            return [[hashes[i] for i in new], [halves(shingle_digests(texts[i], width)) for i in new]]

        return f

    own = docs.select("th", "text").join(texts, "th", "left_semi")
    return written(map_texts(own, ["th", "text"], "th long, shingles binary", make, True).dropDuplicates(["th"]), "shingles")


def _buckets(one: DataFrame, similarity: float) -> DataFrame:
    """Written (key, th, lo, hi): the texts of each band's key that two texts or more have, and the least and greatest of them.

    The minima are cut into one band more than minima may differ at the similarity.  A pair of 0.8 or more that has no whole band in
    common is one in 30,000 at 0.8 and far rarer above.  Keys move once, and only those that texts share are kept."""
    cuts = [len(part) for part in np.array_split(np.arange(MINIMA), MINIMA - least_equal(similarity) + 1)]
    starts = (4 * (np.cumsum(cuts) - cuts) + 1).tolist()
    bands = F.array(*[F.xxhash64(F.substring("minima", a, 4 * n), F.lit(i)) for i, (a, n) in enumerate(zip(starts, cuts))])
    own = Window.partitionBy("key")
    keyed = one.select("th", F.explode(bands).alias("key"))
    met = keyed.select("key", "th", F.min("th").over(own).alias("lo"), F.max("th").over(own).alias("hi"))
    return written(met.where("lo < hi").distinct(), "buckets")


def _candidates(one: DataFrame, met: DataFrame, k: int) -> DataFrame:
    """Distinct pairs (a, b) of text hashes, a < b: fingerprints linked by the trees, and least and greatest of a band's key.

    They join most near copies cheaply; what they leave apart, :func:`crossing` compares."""
    by_fp = one.groupBy("fp").agg(F.min("th").alias("lo"), F.max("th").alias("hi"))
    points = written(by_fp, "points")
    tree = written(linked_points(points.select("fp"), k), "edges")
    root = points.select(F.col("fp").alias("root"), F.col("lo").alias("root_lo"))
    linked = tree.join(points, "fp").join(root, "root").select(F.col("lo").alias("a"), F.col("root_lo").alias("b"))
    same = one.select("fp", "th").distinct().join(points.where("lo < hi"), "fp").select(F.col("th").alias("a"), F.col("lo").alias("b"))
    pairs = linked.union(same).union(met.select("th", "lo")).union(met.select("th", "hi")).where("a != b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _minima(one: DataFrame, texts: DataFrame) -> DataFrame:
    """(th, minima), a row a text, of the given texts; written."""
    return written(one.select("th", "minima").join(texts, "th", "left_semi").dropDuplicates(["th"]), "minima")


def _distinct(texts: DataFrame) -> DataFrame:
    """Distinct th, written, with a broadcast hint up to a bound: what joins them need not move then."""
    texts = written(texts.distinct(), "texts")
    return small(texts, texts.count())


def _sides(pairs: DataFrame, one: DataFrame, column: str) -> DataFrame:
    """pairs with the column's values of both texts, x and y."""
    a = one.select(F.col("th").alias("a"), F.col(column).alias("x"))
    b = one.select(F.col("th").alias("b"), F.col(column).alias("y"))
    return pairs.join(a, "a").join(b, "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return _distinct(pairs.select(F.col("a").alias("th")).union(pairs.select("b")))


def similar_pairs(docs: DataFrame, one: DataFrame, candidates: DataFrame, width: int, similarity: float) -> DataFrame:
    """(fp, root): candidates of the similarity or more; the names are those of edges.  Unsure ones are decided by their shingles."""
    low, high = map(least_equal, UNSURE)
    pairs = written(candidates, "pairs")
    least = _minima(one, _ends(pairs))

    def alike(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(-1, MINIMA) for c in "xy")
            equal = (x == y).sum(axis=1).astype(np.int32)
            keep = pa.array(equal >= low)
            columns = [batch.column(c).filter(keep) for c in "ab"] + [pa.array(equal).filter(keep)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "equal"])

    met = _sides(pairs, least, "minima").select("a", "b", "x", "y").mapInArrow(alike, "a long, b long, equal int")
    met = written(met, "met")
    unsure = met.where(F.col("equal") < high).select("a", "b")
    sets = _shingled(docs, _ends(unsure), width)

    def exact(batches):
        for batch in batches:
            both = zip(batch.column("x"), batch.column("y"))
            keep = pa.array([jaccard(*(np.frombuffer(s.as_py(), dtype=np.uint32) for s in xy)) >= similarity for xy in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in "ab"], names=["a", "b"])

    decided = _sides(unsure, sets, "shingles").select("a", "b", "x", "y").mapInArrow(exact, "a long, b long")
    return met.where(F.col("equal") >= high).select("a", "b").unionAll(decided).toDF("fp", "root")


def _equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of equal minima of each row of x with each of y."""
    if len(x) * len(y) <= 4096:
        return (x[:, None, :] == y[None, :, :]).sum(axis=2)
    out = np.zeros((len(x), len(y)), np.uint8)
    for a, b in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)):
        out += a[:, None] == b[None, :]
    return out


class Side:
    """Texts of a block: their minima, parts and shingles (bytes)."""

    def __init__(self, minima: np.ndarray, part: np.ndarray, shingles: list[bytes]):
        self.minima, self.part, self.shingles = minima, part, shingles

    def at(self, i: int) -> np.ndarray:
        return np.frombuffer(self.shingles[i], dtype=np.uint32)


def joins(x: Side, y: Side, similarity: float) -> list[tuple[int, int]]:
    """Pairs of parts that connect what any two similar texts of x and y connect; fewer than the parts."""
    low, high = map(least_equal, UNSURE)
    names, part = np.unique(np.concatenate([x.part, y.part]), return_inverse=True)
    out, ours, theirs = [], part[: len(x.part)], part[len(x.part) :]
    root = np.arange(len(names))
    equal = _equal(x.minima, y.minima)
    apart = ours[:, None] != theirs[None, :]
    near = (equal >= high) & apart
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        met = np.unique(root[np.append(theirs[near[i]], ours[i])])
        if len(met) > 1:
            out += [(int(names[m]), int(names[met[0]])) for m in met[1:]]
            root[np.isin(root, met)] = met[0]
    for i, j in zip(*(v.tolist() for v in np.nonzero((equal >= low) & (equal < high) & apart))):
        a, b = root[ours[i]], root[theirs[j]]
        if a != b and jaccard(x.at(i), y.at(j)) >= similarity:
            out.append((int(names[b]), int(names[a])))
            root[root == b] = a
    return out


def crossing(docs: DataFrame, one: DataFrame, met: DataFrame, labels: DataFrame, width: int, similarity: float) -> DataFrame:
    """(fp, root): labels of parts that texts of one key connect, by all pairs of texts of a key that are in different parts.

    Least and greatest of a key have met all its texts, and a key within one part needs nothing more.  A large key is cut into
    blocks, a large part of it into its own ones, and tasks get two blocks each; blocks of the same large part are not compared.
    """
    part = F.coalesce("label", "th").alias("part")
    members = met.where("th != lo and th != hi").select("key", "th")
    members = written(members.join(labels, members.th == labels.node, "left").select("key", "th", part), "members")
    several = members.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key")
    sized = written(members.join(several, "key", "left_semi").groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")), "sizes")
    whole = F.when(F.col("n") >= BLOCK, F.col("part"))
    sets = sized.groupBy("key", whole.alias("whole")).agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("own"))
    window = Window.partitionBy("key")
    before = window.orderBy(F.col("whole").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sets = sets.select(
        F.col("key").alias("k"), "whole", "own", F.coalesce(F.sum("own").over(before), F.lit(0)).cast("int").alias("first"),
        F.sum("own").over(window).cast("int").alias("blocks"),
    )
    placed = sized.join(sets, (F.col("key") == F.col("k")) & whole.eqNullSafe(F.col("whole")))
    placed = placed.select("key", "part", "own", "first", "blocks", F.col("whole").isNotNull().alias("is_whole"))
    block = F.col("first") + F.pmod(F.xxhash64("th"), F.col("own")).cast("int")
    rows = members.join(placed, ["key", "part"]).withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    inside = F.col("is_whole") & (F.col("other") >= F.col("first")) & (F.col("other") < F.col("first") + F.col("own"))
    rows = rows.select("*", other).where(~inside)
    rows = rows.select("th", "part", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    rows = written(rows, "blocks")
    texts = _distinct(rows.select("th"))
    sides = _minima(one, texts).join(_shingled(docs, texts, width), "th")
    dealt = rows.join(sides, "th").drop("th").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs(held: pa.Table, ends: list[int]) -> pa.RecordBatch:
        m = np.frombuffer(b"".join(held.column("minima").to_pylist()), dtype=np.uint32).reshape(-1, MINIMA)
        p, i, j, at = (held.column(c).to_numpy() for c in ("part", "i", "j", "block"))
        s = held.column("shingles").to_pylist()
        found: list[tuple[int, int]] = []
        for a, b in zip(ends[:-1], ends[1:]):
            sides = []
            for block in (i[a], j[a]):
                own = a + np.flatnonzero(at[a:b] == block)
                sides.append(Side(m[own], p[own], [s[n] for n in own.tolist()]))
            found += joins(*sides, similarity)
        return pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], pa.int64()) for n in (0, 1)], names=["fp", "root"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            keys = [held.column(c).to_numpy() for c in ("key", "i", "j")]
            starts = (np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist()
            if starts:
                yield pairs(held.slice(0, starts[-1]), [0, *starts])
                held = held.slice(starts[-1])
        if held is not None:
            yield pairs(held, [0, held.num_rows])

    return dealt.mapInArrow(run, "fp long, root long")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, k: int = 3) -> DataFrame:
    """docs with one row of each group of near copies: its least doc_id, the least text hash among repeats of that id.

    Texts of similarity 0.8 differ in up to 14 of 64 bits, where random texts differ in 32 +- 4: at that radius no
    triangle bound prunes, and the trees alone would compare all pairs.  So the trees link what is within k bits, and banded min-wise
    keys give the pairs of lower similarity.  Their share of equal minima decides where it is far from the similarity, else the sets
    of shingles do.  Rows without doc_id count as after all others and keep one row a group too.

    What goes is removed by an anti-join, broadcast up to a bound, so that texts need not move.
    """
    last = F.lit((1 << 63) - 1)
    keyed = docs.select(F.coalesce("doc_id", last).alias("doc_id"), "text", text_hash(F.col("text")).alias("th"))
    with scratch(docs.sparkSession) as made:
        sketched = written(sketches(keyed, width), "sketches")
        one = sketched.where("minima is not null").select("th", "fp", "minima")
        met = _buckets(one, similarity)
        edges = written(similar_pairs(keyed, one, _candidates(one, met, k), width, similarity), "edges")
        first = propagate(edges)
        further = propagate(written(crossing(keyed, one, met, first, width, similarity), "edges"))
        rows = sketched.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
        named = rows.join(first, rows.th == first.node, "left").select("doc_id", "th", "n", F.coalesce("label", "th").alias("part"))
        named = named.join(further, named.part == further.node, "left").select("doc_id", "th", "n", F.coalesce("label", "part").alias("label"))
        named = written(named, "classes")
        best = named.groupBy("label").agg(F.min(F.struct("doc_id", "th")).alias("best"))
        judged = made.keep(written(named.join(best, "label").select("doc_id", "th", "n", (F.struct("doc_id", "th") == F.col("best")).alias("stays")), "judged"))
    id_, th, jid, jth = fresh(docs, "_id", "_th", "_jid", "_jth")

    def those(df: DataFrame, found: DataFrame, rows: int, how: str) -> DataFrame:
        side = found.select(F.col("doc_id").alias(jid), F.col("th").alias(jth))
        return df.join(small(side, rows), (F.col(id_) == F.col(jid)) & (F.col(th) == F.col(jth)), how)

    gone, twice = judged.where("not stays"), judged.where("stays and n > 1")
    n_gone, n_twice = judged.agg(F.count_if(~F.col("stays")), F.count_if(F.col("stays") & (F.col("n") > 1))).first()
    left = those(docs.withColumn(id_, F.coalesce("doc_id", last)).withColumn(th, text_hash(F.col("text"))), gone, n_gone, "left_anti")
    if n_twice:
        left = those(left, twice, n_twice, "left_anti").unionAll(those(left, twice, n_twice, "left_semi").dropDuplicates([id_, th]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5(docs: DataFrame) -> DataFrame:
    return components(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
