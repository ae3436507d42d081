"""Training-data operators on a small table with nulls, empties, repeats and clashing columns, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import decontaminate, language_id, licenses, line_dedup, packing, quality, sharding, simhash, toxicity, url_filter

LINE = "Repeated boiler line that many documents share"
TEXTS = [
    None, "", "   ", "one", "alpha beta", f"Alpha beta gamma.\n{LINE}\nunder the MIT License\n\n{LINE}",
    f"x\n{LINE.upper()}\t\nApache License, Version 2.0 applies", f"{LINE}\ncc by-nc, cc by nc CC BY NC", "short\nshort\nshort",
    " ".join(f"word{i} and" for i in range(5000)), "<|endoftext|> it's ..'s 12,3. naïve CAFÉ", "the quick brown fox jumps over the lazy dog again today",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, "a", "b") for i, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], "en", "s", 1, "a", "b"), (100, TEXTS[9], None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h1 string, s string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_line_dedup(docs, empty):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    holders = defaultdict(set)
    for i, t in rows:
        for x in t.split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(i)
    want = []
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == i]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert sorted(map(tuple, line_dedup.op3(docs).collect())) == sorted(want)
    assert line_dedup.op3(empty).count() == 0 and set(docs.columns) < set(line_dedup.dedup_lines(docs).columns)


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.update((r.doc_id, s, zlib.crc32(np.array(ids[s : s + 64], dtype="<u4").tobytes())) for s in range(0, len(ids), 64))
    got = packing.pack(docs, path, max_len=64).collect()
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack(empty, path).count() == 0


def test_shortest_pack_first_places_all():
    rng = np.random.default_rng(1)
    lengths = Counter(rng.integers(1, 257, size=5000).tolist())
    patterns = packing.shortest_pack_first(lengths, 256)
    placed = Counter()
    for copies, pattern in patterns:
        assert sum(length * n for length, n in pattern) <= 256
        for length, n in pattern:
            placed[length] += copies * n
    assert placed == lengths


def test_simhash_links(docs, empty):
    rows = docs.collect()
    fp = [simhash.fingerprint((r.text or "").encode()) & (2**64 - 1) for r in rows]
    parent = list(range(len(rows)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r.doc_id)
    want = Counter((r.doc_id, f"{fp[i]:016x}", min(least[find(i)])) for i, r in enumerate(rows))
    assert Counter(map(tuple, simhash.op5(docs).collect())) == want
    assert simhash.op5(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_keep_one_equals_brute_force_in_a_template_group(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, size=n)]
    template, texts = words(165), []
    for _ in range(200):
        own = template + words(35)
        copy = own[:-14] + words(14)
        texts += [" ".join(own), " ".join(copy)]
    ids = rng.permutation(len(texts)).tolist()
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for t in texts]
    alike = [np.array([5 * len(a & b) >= 4 * len(a | b) for b in sets]) for a in sets]
    least = list(ids)
    while True:
        after = [min(np.array(least)[row]) for row in alike]
        if after == least:
            break
        least = after
    table = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    assert 1 < len(set(least)) < len(texts)
    assert sorted(r.doc_id for r in simhash.keep_one(table).collect()) == sorted(set(least))
    monkeypatch.setattr(simhash, "BLOCK", 8)
    assert sorted(r.doc_id for r in simhash.keep_one(table).collect()) == sorted(set(least))


def test_star_edges_equal_brute_force():
    rng = np.random.default_rng(3)
    far = rng.integers(0, 1 << 63, size=1500, dtype=np.uint64)
    near = far[:200, None] ^ (np.uint64(1) << rng.integers(0, 63, size=(200, 3), dtype=np.uint64))
    dense = np.uint64(12345) ^ rng.integers(0, 1 << 9, size=400, dtype=np.uint64)
    points = np.unique(np.concatenate([far, near.ravel(), dense]))
    tree = simhash.build_tree(points[::3], 8, 2)
    parent = {int(p): int(p) for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, part in simhash.deal(points, tree, 2):
        for a, b in zip(*simhash.star_edges(part, 2)):
            a, b = find(int(a)), find(int(b))
            parent[max(a, b)] = min(a, b)
    got = {int(p): find(int(p)) for p in points}
    close = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    label = np.arange(len(points))
    while True:
        after = np.array([label[row].min() for row in close])
        if (after == label).all():
            break
        label = after
    assert [got[int(p)] for p in points] == [int(points[i]) for i in label]


def test_sharding(docs, empty):
    got = sharding.op6(docs).collect()
    assert all(r.grown_shard in (r.shard, 8) for r in got) and len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.size == len((TEXTS[r.doc_id if r.doc_id < 100 else 9] or "").encode()) + 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.op6(empty).count() == 0


def test_licenses(docs, empty):
    phrases = {tuple(p.split()): label for p, label in licenses.BASE}
    for r in licenses.op8(docs).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(TEXTS[r.doc_id if r.doc_id < 100 else 9]))
        hit = [(i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        places = [i for i, _ in hit]
        want = (len(w), len(hit), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hit})))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.op8(empty).count() == 0 and len(licenses.rules()) > 200


def samples(parsed):
    """Strings an expression matches, each alternative at least once."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            some = [chr(arg)]
        elif op == "IN":
            some = [chr(c) for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1))]
        elif op == "BRANCH":
            some = [x for branch in arg[1] for x in samples(branch)]
        elif op == "MAX_REPEAT":
            some = [*samples(arg[2]), ""] if arg[0] == 0 else samples(arg[2])
        elif op == "SUBPATTERN":
            some = samples(arg[3])
        else:
            assert op == "ASSERT_NOT", op
            some = [""]
        # Each string so far with the first choice, and the first string with each other choice.
        out = [x + some[0] for x in out] + [out[0] + x for x in some[1:]]
    return out


def test_license_gates_hold_for_every_alternative(spark):
    for r in licenses.rules():
        for x in samples(re._parser.parse(r["regex"])):
            s = f" {x} "
            if re.search(r["regex"], s):
                assert r["cue"] in s and r["kw"] in s, (r["label"], s)
    texts = ["Licensed under the X Consortium License.", "released under the FreeBSD License", "confidential and confidential"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.op8(table).collect()}
    assert got == {0: ("x11", 1.0), 1: ("bsd-2-clause", 1.0), 2: ("proprietary", 0.6)}


def test_decontaminate(spark, docs, empty):
    bench = spark.createDataFrame([(1, "QUICK brown, fox"), (2, None), (3, " ".join(f"word{i} and" for i in range(30, 36)))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.op9(docs, bench).collect()}
    assert (got[11].n_hit, got[11].n_items, got[9].n_hit, got[100].n_hit, got[0].n_words) == (3, 1, 12, 12, 0)
    assert got[11].items_sha256 == hashlib.sha256(b"1").hexdigest() and not got[5].contaminated
    loose = decontaminate.matches(docs, spark.createDataFrame([(7, "brown jumps lazy")], "item_id long, text string"), slop=3)
    assert [r.doc_id for r in loose.collect() if r["items"]] == [11]
    assert decontaminate.op9(empty, bench).count() == 0
    old = decontaminate.MAX_WINDOWS
    try:
        decontaminate.MAX_WINDOWS = 1
        assert {r.doc_id: r for r in decontaminate.op9(docs, bench).collect()} == got
    finally:
        decontaminate.MAX_WINDOWS = old
    assert decontaminate.clean(docs, bench).where("doc_id in (9, 11, 100)").count() == 0


def test_url_filter(spark):
    urls = [None, "", "nourl", "http://A.Example.ORG/en/12?x", "https://example.org/es/", "http://x.com/fr/1", "http://y.com", "http://casino.net/a", "http://casinos.net/a", "http://free-bets-x.net/cheap/bonus", "http://notorg/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.op4(pages).collect()}
    assert got[0] == ("", "", None, "allow") and got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/en/12", "example.org/en/1", "block") and got[4][2:] == ("example.org/es/", "block")
    assert got[5][2:] == ("com/fr/", "allow") and got[6][2:] == (None, "allow")
    assert [got[i][3] for i in (7, 8, 9, 10)] == ["block", "allow", "block", "allow"]


def test_quality_base_rules(docs, spark):
    labels = spark.createDataFrame([(5, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.op10(docs, labels).collect()}
    assert (got[8].n_dup_lines, got[8].n_repeat_words, got[0].n_words, got[0].kept) == (2, 0, 0, False)
    assert quality.repeat_words("a b c a b c x".encode().split()) == 6 and quality.repeat_words(b"a a a a".split()) == 4
    assert got[9].n_words == 10_000 and not got[9].base_failed


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    crf = quality.Crf(rng.normal(size=(2, 11)), rng.normal(size=(2, 2)))
    x = rng.normal(size=(7, 11))
    score = lambda y: sum((x[i] @ crf.emit[y[i]]) for i in range(7)) + sum(crf.move[y[i], y[i + 1]] for i in range(6))
    best = max(([k >> i & 1 for i in range(7)] for k in range(128)), key=score)
    assert crf.viterbi(x).tolist() == best


def test_toxicity_restores_and_holds_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.op7(docs, labels).collect()}
    held = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p for t, p in held if not t) <= 0.05 * len(held) and len(got) == docs.count()
    model = toxicity.fit([("a clown here", 1), ("you are a clown", 1)] * 1 + [(f"some clown number {i}", 1) for i in range(9)] + [(f"nice day {i}", 0) for i in range(60)])
    assert all(model.score(f"such a {w}!") >= 0.7 for w in ("clown", "cl0wn", "c l o w n", "CLOOOWN", "c.l.o.w.n"))
    assert model.score("nice day") < 0.7 and 0 <= model.score("") <= 1


def test_toxicity_evidence():
    long = " ".join(f"word{i}" for i in range(60))
    assert toxicity.families([long, f"{long} end", "other words here", "", ""]) == [0, 0, 2, 3, 4]
    nice = [(f"nice day {i}", 0) for i in range(60)]
    model = toxicity.fit([(f"{long} {i}", 1) for i in range(30)] + nice)
    assert model.score("word7") < 0.7, "near copies are one piece of evidence"
    model = toxicity.fit([(f"a{i} b{i} zork{chr(97 + i)}x zork{chr(98 + i)}yy", 1) for i in range(20)] + [(f"c{i} zorkable", 0) for i in range(20)] + nice)
    assert model.score("zorkly zorkish") >= 0.7 and model.score("zorkly") < 0.7


def test_toxic_passage_scores_alike_in_a_long_text():
    rows = [(f"a{i} b{i} zork{chr(97 + i)}x zork{chr(98 + i)}yy", 1) for i in range(20)] + [(f"c{i} zorkable", 0) for i in range(20)]
    model = toxicity.fit(rows + [(f"nice day {i}", 0) for i in range(60)])
    filler = lambda n: " ".join(f"fill{chr(97 + i % 26)}{i}" for i in range(n))
    passage = "zorkly is zorkish"
    short, long = model.score(passage), model.score(f"{filler(1900)} {passage} {filler(1500)}")
    assert short == long >= 0.7
    assert model.score(f"zorkly {filler(500)} zorkish") < 0.7


def test_toxicity_restores_long_and_spaced_disguises():
    toxic = [(f"you clown number {i}", 1) for i in range(20)] + [(f"such an idiot i met {i}", 1) for i in range(20)]
    nice = [(t, 0) for i in range(30) for t in (f"you have a nice day {i}", f"i met a friend and you met such an old number {i}")]
    model = toxicity.fit(toxic + nice)
    spaced = lambda t: " ".join(t.replace(" ", ""))
    letters = spaced("you have a nice day and i met an old friend and you met such a nice friend you clown i met a friend and an old day")
    assert len(letters.split()) > 64
    hidden = ["idi" + 80 * "o" + "t", "cl0" + 70 * "w" + "n", "y o u i d i o t", "y o u c l o w n", "a i d i o t I", "an i d i o t i met", letters]
    assert [t for t in hidden if model.score(t) < 0.7] == []
    assert model.score(spaced("you have a nice day")) < 0.7 and model.score("a" * 500 + "1" * 500) < 0.7
    assert model.score("1 2 3 4 5 6") < 0.7 and model.score("x9" * 50_000) < 0.7


def test_language(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    got = language_id.op1(table).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.97 * len(held)
    model = language_id.fit_counts([("en", "the cat"), ("de", "der hund")])
    assert model.predict("") == ("und", 0.0) and model.predict("12 !") == ("und", 0.0) and model.predict("the hunds")[0] in ("en", "de")
    assert language_id.fit_counts([]).predict("word") == ("und", 0.0)


def test_pipeline_runs_on_a_small_table(spark, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert out and len({r.sequence_id for r in out}) == max(r.sequence_id for r in out) + 1
