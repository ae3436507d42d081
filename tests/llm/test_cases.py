"""Operators against brute force and planted cases, and the defined cases of odd tables."""

import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash

from quarry.llm import common, decontaminate, language_id, licenses, line_dedup, packing, quality, sharding, simhash, toxicity, url_filter
from quarry.llm.license_rules import rules

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), size=rng.integers(3, 9))) for _ in range(n))


# Quality


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    crf = quality.Crf(rng.normal(size=(2, 11)), rng.normal(size=(2, 2)))
    x = rng.normal(size=(1, 5, 11))
    mask = np.array([[1, 1, 1, 1, 0.0]])
    node, pair = quality.marginals(x * mask[:, :, None], mask, crf)
    paths = [[k >> i & 1 for i in range(4)] for k in range(16)]
    p = np.exp([sum(x[0, i] @ crf.emit[y[i]] for i in range(4)) + sum(crf.move[y[i], y[i + 1]] for i in range(3)) for y in paths])
    p /= p.sum()
    for i in range(4):
        assert node[0, i, 1] == pytest.approx(sum(q for q, y in zip(p, paths) if y[i]))
    assert pair[0, 1, 0, 1] == pytest.approx(sum(q for q, y in zip(p, paths) if y[1:3] == [0, 1]))
    assert node[0, 4].sum() == 0 and pair[0, 3].sum() == 0


def test_lines_differ_within_documents():
    rng = np.random.default_rng(3)
    content = lambda: words(rng, 12).capitalize() + "."
    menu = lambda: " | ".join(words(rng, 9).split()).upper() + " $$$ ###"
    good = [("\n".join(content() for _ in range(6)), 1) for _ in range(60)]
    bad = [("\n".join([content(), *[menu() for _ in range(6)], content()]), 0) for _ in range(40)]
    crf = quality.fit_crf([t.encode() for t, _ in good + bad], [g for _, g in good + bad])
    text = "\n".join([content(), content(), menu(), menu(), menu(), content()]).encode()
    assert crf.viterbi(np.array(quality.lines_of(text)[1])).tolist() == [1, 1, 0, 0, 0, 1]
    assert [int(crf.viterbi(np.array(quality.lines_of(t.encode())[1])).sum()) for t, _ in bad] == [2] * 40


# Licenses


def brute_resolved(spans):
    kept = []
    for x in sorted(spans):
        if all(y[3] < x[2] or x[3] < y[2] for y in kept):
            kept.append(x)
    return sorted(kept)


def test_license_suppression_is_by_priority(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    cases = [[(1, 10, 12), (9, 5, 20)], [(1, 0, 10), (3, 5, 15), (2, 8, 20)], []]
    for _ in range(30):
        starts = rng.integers(0, 400, size=rng.integers(1, 25))
        cases.append([(int(rng.integers(0, 9)), int(s), int(s + rng.integers(0, 12))) for s in starts])
    spans = [[(p, a - b, a, b, "x", 1.0) for p, a, b in case] for case in cases]
    df = spark.createDataFrame(list(enumerate(spans)), f"i int, s array<{licenses._SPAN}>")
    got = df.select("i", licenses.resolved(F.array_sort(F.array_distinct("s"))).alias("k")).collect()
    assert {r.i: sorted(map(tuple, r.k)) for r in got} == {i: brute_resolved(set(s)) for i, s in enumerate(spans)}
    assert brute_resolved(spans[0]) == [spans[0][0]] and len(brute_resolved(spans[1])) == 1


def samples(parsed):
    """Strings that an expression matches, each alternative and each optional part at least once."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            some = [chr(arg)]
        elif op == "IN":
            some = [chr(c) for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1))]
        elif op == "BRANCH":
            some = [x for branch in arg[1] for x in samples(branch)]
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            some = [*samples(arg[2]), ""] if arg[0] == 0 else samples(arg[2])
        elif op == "SUBPATTERN":
            some = samples(arg[3])
        else:
            assert op == "ANY", op
            some = ["x"]
        out = [x + some[0] for x in out] + [out[0] + x for x in some[1:]]
    return out


def test_every_signature_finds_its_own_samples(spark):
    every = rules()
    assert len(every) > 200 and len({(r.label, r.regex) for r in every}) == len(every)
    texts, of = [], []
    for r in every:
        assert r.regex.count("@") == 1
        for x in samples(re._parser.parse(r.regex)):
            plain = re.sub(" +", " ", x.replace("@", "")).strip()
            assert f" {r.keyword} " in f" {plain} " and len(plain.split()) <= licenses.REACH
            texts.append(f"Filler words here, {plain.title()}; and after")
            of.append(r)
    from pyspark.sql import functions as F

    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = table.select("doc_id", licenses.detections(licenses.words_of(F.col("text")), every).alias("s")).collect()
    missed = [(of[r.doc_id].label, texts[r.doc_id]) for r in found if of[r.doc_id].prio not in {x.prio for x in r.s}]
    assert missed == []
    by_id = {r.doc_id: r for r in licenses.scanned(table).collect()}
    assert all(r["labels"] for r in by_id.values())


def test_license_places(spark):
    texts = ["cc by nc cc by nc sa 4.0 cc by nc", "Licensed under the X Consortium License.", "MIT-License; Licensed under CC BY-NC-SA 4.0", None, "", "mit " * 500]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scanned(table).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0]["labels"]) == (3, 0, 9, ["cc-by-nc", "cc-by-nc-sa"])
    assert got[1]["labels"] == ["x11"] and got[2]["labels"] == ["cc-by-nc", "cc-by-nc-sa", "mit"] and got[2].score == 1.0
    assert [(x.start, x.stop, x.label) for x in got[2].kept] == [(0, 1, "mit"), (4, 9, "cc-by-nc-sa")]
    assert (got[3].n_words, got[3]["labels"], got[3].score, got[5].n_words, got[5]["labels"]) == (0, [], 0.0, 500, [])


# URL filter


def test_url_rule(spark):
    urls = {
        "http://adserver.net/": "allow", "http://shop.net/free/bonus": "block", "http://shop.net/?q=casino": "allow", "casino": "allow", "http://x.net/best/new": "allow",
        "http://x.net/porn": "block", "http://x.net/PORN-Hub": "block", "http://x.net/pornés": "allow", "http://x.net/éporn": "allow", "http://payday_loan.net": "block",
        "http://free.net/free": "allow", "http://x.net/cheap/cheap-pills": "block", "http://x.net/#porn": "allow", "http://spam-farm.net/": "block",
    }
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.op4(table).collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values())
    a = url_filter.automaton(("bad",), {"worse": 3, "bad": 1, "ill": 1})
    assert url_filter.counted(b"bad.worse-worse.net", b"/ill/bad", a, {"worse": 3, "bad": 1, "ill": 1}) == (1, 2, 4)
    assert all(re.fullmatch("[a-z0-9]+", t) for t in url_filter.SOFT) and all(re.fullmatch("[a-z0-9-]+", t) for t in url_filter.STRICT)


# Language


def test_only_letters_make_words(spark):
    assert language_id.words("½ ² Ⅷ 12 _") == [] and language_id.words("a½b Don't") == ["a", "b", "don", "t"]
    model = language_id.fit_counts([("en", "the cat"), ("de", "der hund")])
    assert model.predict("½ ² Ⅷ") == ("und", 0.0)


def test_backoff_takes_the_longest_known_gram():
    model = language_id.fit_counts([("en", "that that than"), ("de", "dass dass das")])
    found = []
    at, marked = 0, "^thaz$"
    while at < len(marked):
        size = next((n for n in (4, 3, 2, 1) if marked[at : at + n] in model.grams), 0)
        if size:
            found.append(model.grams[marked[at : at + size]])
        at += size or 1
    assert model.backoff("thaz").tolist() == (model.scores[found].sum(axis=0) / len(found)).tolist()
    assert model.predict("thaz")[0] == "en" and model.predict("dasz")[0] == "de"


# Sharding


def draw_shard(key, node, path=""):
    if not isinstance(node, dict):
        return node if isinstance(node, int) else None
    best = None
    for name, child in node.items():
        weight = sharding._weight(child)
        if weight <= 0:
            continue
        h = xxhash.xxh64_intdigest(f"{path}/{name}".encode(), xxhash.xxh64_intdigest(key.encode(), 42))
        draw = -np.log(((h >> 11) + 0.5) / float(1 << 53)) / weight
        if best is None or draw < best[0]:
            best = draw, name, child
    return best[1] if not isinstance(best[2], dict) else draw_shard(key, best[2], f"{path}/{best[1]}")


def test_shards_equal_recomputed_draws(spark):
    texts = ["é" * 7, None, "abc", ""]
    docs = spark.createDataFrame([(i * 7919 if i % 50 else None, texts[i % 4]) for i in range(400)], "doc_id long, text string")
    got = sharding.op6(docs).collect()
    for r in got:
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (draw_shard(key, sharding.EIGHT), draw_shard(key, sharding.NINE))
    crc = Counter((r["size"], r.text_crc32) for r in got)
    assert crc == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in [texts[i % 4] for i in range(400)])
    tree = {"a": {"r": {0: 1.0, 1: 3.0}}, "b": {"s": {2: 4.0}}}
    from pyspark.sql import functions as F

    ids = spark.range(4000).select("id", sharding.assign_shard(F.col("id"), tree).alias("before"), sharding.assign_shard(F.col("id"), tree | {"b": {"s": {2: 8.0}}}).alias("after"))
    moved = ids.groupBy("before", "after").count().collect()
    assert all(r.before == r.after or r.after == 2 for r in moved), "only the grown subtree takes rows"
    share = Counter()
    for r in moved:
        share[r.before] += r["count"] / 4000
    assert abs(share[0] - 0.125) < 0.03 and abs(share[1] - 0.375) < 0.04 and abs(share[2] - 0.5) < 0.04


# SimHash


def components_of(points, k):
    close = np.bitwise_count(points[:, None] ^ points[None, :]) <= k
    label = np.arange(len(points))
    while True:
        after = np.array([label[row].min() for row in close])
        if (after == label).all():
            return label
        label = after


def test_dense_balls_are_cut_by_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    low = np.uint64((1 << 18) - 1)
    for spread in (low, np.uint64(0x0F0F0F0F0F0F0F0F)):
        ball = np.unique(np.uint64(77777) ^ (rng.integers(0, 1 << 63, size=3000, dtype=np.uint64) & spread))
        monkeypatch.setattr(simhash, "SEARCHED", 64)
        monkeypatch.setattr(simhash, "ALL_PAIRS", 16)
        for name in ("WORST_DEAL", "WORST_SPLIT"):
            monkeypatch.setattr(simhash, name, 0.0)  # nothing counts as a split
        tree = simhash.build_tree(ball[::5], 8, 2)
        assert isinstance(tree, simhash.Dense) and (np.bitwise_or.reduce(np.array(tree.masks, np.uint64)) == np.uint64(2**64 - 1))
        parent = {int(p): int(p) for p in ball}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        dealt = list(simhash.deal(ball, tree, 2))
        assert len(dealt) > 8 and max(len(p) for _, p in dealt) < len(ball)
        for _, part in dealt:
            for a, b in zip(*simhash.star_edges(part, 2)):
                a, b = find(int(a)), find(int(b))
                parent[max(a, b)] = min(a, b)
        label = components_of(ball, 2)
        assert [find(int(p)) for p in ball] == [int(ball[i]) for i in label]


def test_jaccard():
    a, b = np.array([1, 3, 5, 9], np.uint32), np.array([3, 5, 7], np.uint32)
    none = np.array([], np.uint32)
    assert simhash.jaccard(a, b) == simhash.jaccard(b, a) == 2 / 5 and simhash.jaccard(none, none) == 1 and simhash.jaccard(none, a) == 0


def brute_near(rows, least=0.8):
    """The ids that stay of (doc_id, text): one of each group linked by 5-word similarity."""
    sets = []
    for _, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= least * len(a | b)):
                label[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[find(i)].append(doc_id)
    return sorted(min(g) for g in groups.values())


def test_near_copies_down_to_the_threshold(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(120):
        own = words(rng, 100).split()
        rows.append((2 * i, " ".join(own)))
        n = int(rng.integers(1, 14))  # similarities from 0.98 to 0.75
        rows.append((2 * i + 1, " ".join(own[:-n] + words(rng, n).split())))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(table).collect()) == brute_near(rows)


def test_near_copies_among_repeats_in_several_tasks(spark):
    rng = np.random.default_rng(15)
    rows = []
    for i in range(40):
        own = words(rng, 100).split()
        n = int(rng.integers(4, 12))  # similarities from 0.93 to 0.78
        texts = [" ".join(own), " ".join(own[:-n] + words(rng, n).split())]
        rows += [(10 * i + j, texts[j % 2]) for j in range(6)]
    table = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in simhash.keep_one(table).collect()) == brute_near(rows)


def test_near_copies_write_far_less_than_the_texts(spark, monkeypatch):
    rng, sizes = np.random.default_rng(16), []

    def written(df, name):
        out = common.written(df, name)
        sizes.append(sum(p.stat().st_size for p in Path(out._written).rglob("*.parquet")))
        return out

    monkeypatch.setattr(simhash, "written", written)
    texts = [" ".join(map(str, rng.integers(10**6, size=2500))) for _ in range(400)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.keep_one(table).count() == 400
    assert sum(sizes) < 0.25 * sum(map(len, texts)), "sets of shingles are made for unsure pairs alone"


# Decontamination


def brute_windows(rows, items, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for item, t in items:
        w = split(t)
        for i in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[i : i + width])].add(item)
    out = []
    for doc, t in rows:
        w, hit, got = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    got |= own
        out.append((doc, len(w), len(hit), tuple(sorted(x for x in got if x is not None))))
    return sorted(out, key=repr)


def test_decontamination_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(vocabulary, size=n))
    rows = [(i, text(int(rng.integers(0, 200)))) for i in range(60)] + [(None, text(50)), (3, None), (61, text(3000))]
    items = [(i, text(n)) for i, n in enumerate([3, 4, 2, 30, 9, 10, 11, 1, 0])] + [(None, text(3)), (2, "W1 w2"), (50, " ".join(rows[5][1].split()[20:45]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_windows(rows, items)
    got = lambda: sorted(((r.doc_id, r.n_words, n, tuple(r["items"])) for r in decontaminate.matches(docs, bench).collect() for n in [sum(s.stop - s.start for s in r.spans)]), key=repr)
    assert got() == want
    monkeypatch.setattr(decontaminate, "PLACES", 7)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 500)
    assert got() == want
    rows_ = decontaminate.op9(docs, bench).select("doc_id", "n_words", "n_hit").collect()
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", 5)
    chunks = list(decontaminate.chunks_of(bench, 10, 5))
    assert len(chunks) > 5 and max(len(c.items) for c in chunks) == 5, "an item's windows are cut too"
    assert sorted(map(repr, decontaminate.op9(docs, bench).select("doc_id", "n_words", "n_hit").collect())) == sorted(map(repr, rows_))


def test_index_positions_take_two_bytes_unless_a_document_is_longer(spark):
    rng = np.random.default_rng(17)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary, size=n))
    rows = [(i, text(3000)) for i in range(50)] + [(50, text(70_000)), (51, text(20)), (52, "a " * 65_535), (53, "a " * 65_536), (54, None)]
    items = [(i, " ".join(rows[i][1].split()[-12:])) for i in (0, 20, 21, 22, 49, 50, 51)] + [(60, "a " * 10), (61, rows[50][1].split()[66_000] + " w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), tuple(r["items"])) for r in decontaminate.matches(docs, bench).collect()]
    assert sorted(got, key=repr) == brute_windows(rows, items)
    blocks = [(sum(r.n_words), len(r.n_words), len(r.positions)) for r in decontaminate.build_index(docs).collect()]
    assert sum(n for n, _, _ in blocks) == sum(len((t or "").split()) for _, t in rows)
    assert all(size == (2 if n + gaps <= 1 << 16 else 4) * n and (gaps == 1 or n + gaps <= 1 << 16) for n, gaps, size in blocks)


# Toxicity


def test_toxicity_chunks_doubles_and_joined_words():
    toxic = [(f"you clown number {i}", 1) for i in range(20)] + [(f"such an idiot i met {i}", 1) for i in range(20)]
    nice = [(t, 0) for i in range(60) for t in (f"you have a nice day {i}", f"i met a friend and you met such an old number {i}")]
    model = toxicity.fit(toxic + nice)
    hidden = ["cl ow n", "you cl own", "id iot", "ccllown", "cloown", "idiiot", "iddioot", "youclown", "suchanidiot", "you!cl0wn!", "c.l.o.w.n", "cl" + 20 * "o" + "wn", "cl" + 70 * "o" + "wn"]
    assert [t for t in hidden if model.score(t) < 0.7] == []
    assert [t for t in ("you have a day", "a nice day", "nicceday", "h a v e a day") if model.score(t) >= 0.7] == []


def test_character_counts_equal_brute_force(spark):
    texts = ["Hello, world hello", "Привет мир w0rld", None, "", "a be sea", "naïve ñandú œuvre"]
    df = spark.createDataFrame([(t,) for t in texts * 3], "text string")
    three, short = Counter(), Counter()
    for t in texts * 3:
        for w in (t or "").lower().split():
            bare = w.strip(toxicity._EDGE)
            if bare.isalpha():
                s = f"^^{toxicity.folded(bare)}$"
                three.update(s[i - 2 : i + 1] for i in range(2, len(s)))
                if len(bare) <= toxicity.CHUNK:
                    short[toxicity.folded(bare)] += 1
    got, want = toxicity.corpus_chars(df, flush=4), toxicity.char_model(three, short)
    assert (got.three, got.two, got.one, got.chunks) == (want.three, want.two, want.one, want.chunks)


# Packing


def test_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), packing.Encoder(path, cache_chunks=300)
    rng = np.random.default_rng(1)
    alphabet = list("aàÀÉßçñ.,;!'\"<|>09 \n\t\x0b") + ["İ", "K", "中", "语", "é", " ", "😀", "ﬁ", "Σ", "ς"]
    texts = ["".join(rng.choice(alphabet, size=rng.integers(0, 60))) for _ in range(1500)] + ["", "<|endoftext|>", "x" * 3000]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    got = [np.frombuffer(b, dtype="<u4").tolist() for b in own.batch([t.encode() for t in texts])]
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []


def test_chunks_merged_together_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), packing.Encoder(path)
    rng = np.random.default_rng(2)
    letters = list("etaoinshrdluETA")
    signs = list("etaoinsvmlrd019.,!$-</w>\x00\x1c\x1f\x7f\t\x0b\x0c\r" + 6 * "'") + ["é", "è", "ß", "中", "’", "٣", "\u0301", "\u0085", "\u00a0"]
    asc = [c for c in signs if c.isascii()] + ["é", "è"]
    texts = [" ".join("".join(rng.choice(some, size=rng.integers(0, 40) if long else rng.integers(0, 9))) for _ in range(30)) for some in (letters, signs, asc) for long in (0, 1) for _ in range(170)]
    texts += ["aaaa" * n for n in range(12)] + ["don't l'homme d'squelette it's!'s 's '' we'll'", "the</w>the <|startoftext|>THE"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    got = [np.frombuffer(b, dtype="<u4").tolist() for b in own.batch([t.encode() for t in texts])]
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []


def test_frequent_chunks_stay_cached():
    import public_tokenizers

    own = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), cache_chunks=4000)
    learnt, learn = Counter(), own.learn
    own.learn = lambda missing: (learnt.update(missing), learn(missing))
    rng = np.random.default_rng(3)
    common = words(rng, 100).split()
    for _ in range(40):  # each batch has the common words and 500 others
        list(own.batch([" ".join([*common, *words(rng, 500).split()]).encode()]))
        assert len(own.cache) <= 4000
    assert max(learnt[w.encode()] for w in common) == 1


# Odd tables


CLASH = "_id long, _TH string, _lines string, _bits string, bits string, _bn int, _bid int, _bth int, _keep int, _hit string, _jid int, _jth int, best int, label string, n int, stays int, text_ string, doc_id long, text string, lang string, source string, n_chars long, n_lines int"


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(5)
    own = [words(rng, 30) for _ in range(4)]
    texts = [None, "", " ", "a", own[0], own[0], own[1] + "\n" + own[2], own[2] + "\n" + own[3]]
    rows = [(i if i % 3 else None, t) for i, t in enumerate(texts)] + [(4, own[0]), (4, own[0]), (4, own[3])]
    return spark.createDataFrame([(7, "x", "x", "x", "x", 7, 7, 7, 7, "x", 7, 7, 7, "x", 7, 7, "x", i, t, None, None, None, 7) for i, t in rows], CLASH)


def test_clashing_names_and_nulls(spark, odd):
    same = lambda df: [c for c in df.columns]
    deduped = line_dedup.dedup_lines(odd)
    assert same(deduped)[:-2] == same(odd)[:-1] and deduped.count() == odd.count()
    assert {tuple(r)[:17] for r in deduped.collect()} == {tuple(r)[:17] for r in odd.collect()}
    kept = simhash.keep_one(odd)
    assert same(kept) == same(odd)
    rows = kept.collect()
    assert Counter(r.text for r in rows if r.text and len(r.text) > 5)[odd.collect()[4].text] == 1 and all(r._id == 7 for r in rows)
    bench = spark.createDataFrame([(1, odd.collect()[4].text)], "item_id long, text string")
    clean = decontaminate.clean(odd, bench)
    assert same(clean) == same(odd) and clean.count() == odd.count() - 4
    assert toxicity.drop_toxic(odd, toxicity.fit([])).count() == odd.count()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 0, 1), (5, 0, 0), (None, 1, 1), (99, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")


def results(docs, labels, bench):
    import public_tokenizers

    yield language_id.op1(docs)
    yield packing.op2(docs, public_tokenizers.path("word_bpe_49k.json"))
    yield line_dedup.op3(docs)
    yield simhash.op5(docs)
    yield sharding.op6(docs)
    yield toxicity.op7(docs, labels)
    yield licenses.op8(docs)
    yield decontaminate.op9(docs, bench)
    yield quality.op10(docs, labels)


def test_null_ids_and_empty_tables(spark, odd, labels):
    bench = spark.createDataFrame([(1, "a b c"), (None, None)], "item_id long, text string")
    for df in results(odd, labels, bench):
        assert df.count() == odd.count()
    for df in results(odd, labels.where("false"), bench.where("false")):
        assert df.count() == odd.count()
    for df in results(odd.where("false"), labels, bench):
        assert df.count() == 0
    pages = spark.createDataFrame([(None, "http://a.org/"), (1, None), (1, None)], "page_id long, url string")
    assert sorted(r.verdict for r in url_filter.op4(pages).collect()) == ["allow"] * 3 and url_filter.op4(pages.where("false")).count() == 0


def test_fits_hold_each_id_once(spark):
    docs = spark.createDataFrame([(7, f"text {i} of one id", "en", "s", 1) for i in range(300)] + [(8, "x" * 50, "de", "s", 1)], DOC)
    labels = spark.createDataFrame([(7, i % 2, 0) for i in range(300)] + [(8, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(common.sampled(docs, labels, "quality", 1000, 1000)) == 2
    assert common.sampled(docs, labels, "toxic", 1000, 30) == [("text 0 of one id", 0)]
    assert len(common.sampled(docs, docs, "lang", 5, 1000)) <= 2


def test_lower_ascii_is_exact(spark):
    from pyspark.sql import functions as F

    rows = [(chr(c),) for c in range(1, 0x3000) if not 0xD800 <= c <= 0xDFFF] + [("AΣ",), ("ǅZ",), ("éA",), ("İK",), ("Ⓐ Z",), (None,)]
    df = spark.createDataFrame(rows, "x string")
    assert df.where(~F.translate("x", common.UPPER, common.LOWER).eqNullSafe(common.lower_ascii(F.col("x")))).count() == 0


def test_small_sides_are_checked(spark):
    df = spark.range(3)
    assert "ResolvedHint" in common.small(df, 3)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in common.small(df, common.BROADCAST_ROWS + 1)._jdf.queryExecution().analyzed().toString()


def test_bitmaps_beyond_the_bound_join_by_shuffle(spark, monkeypatch):
    rows = [(i, f"a line that all share\nown line number {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, line_dedup.op3(docs).collect()))
    monkeypatch.setattr(line_dedup, "BITMAP_WORDS", 3)
    assert sorted(map(tuple, line_dedup.op3(docs).collect())) == want and sum(r[2] for r in want) == 49


# The pipeline


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = np.random.default_rng(21)
    shared = "This very line stands in many documents"
    item = words(rng, 14)
    rows = []
    for i in range(90):
        body = words(rng, 40)
        if i % 9 == 1:
            body += " you clown" if i % 2 else " you cl0wn"
        if i % 7 == 2:
            body = f"{body}\n{shared}\n{words(rng, 20)}"
        if i % 11 == 3:
            body += " " + item
        rows.append((i, body))
        if i % 10 == 4:
            rows.append((1000 + i, body + " tail"))
        if i % 13 == 5:
            rows.append((2000 + i, body))
    rows += [(3000, shared), (3001, None), (3002, ""), (3003, shared.upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)
    labels = [(i, 1, int(i % 9 == 1)) for i, t in rows if i < 1000]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(i, t or "") for i, t in rows if not (t and re.search("cl[o0]wn", t))]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    first: dict = {}
    for i, t in sorted(left):
        for x in t.split("\n"):
            if len(key(x)) >= 10:
                first.setdefault(key(x), i)
    after = []
    for i, t in left:
        kept = [x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == i]
        if len(kept) == len(t.split("\n")) or "".join(kept).strip():
            after.append((i, "\n".join(kept)))
    stay = set(brute_near(after))
    after = [(i, t) for i, t in after if i in stay]
    clean = {i for i, _, hit, _ in brute_windows(after, [(1, item)]) if not hit}
    after = [(i, t) for i, t in after if i in clean]
    assert 0 < len(after) < len(left) < len(rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in after:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want[i, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        ends = [a + n for a, n in sorted(pieces)]
        assert [a for a, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 4096
