"""SentencePiece spans, substring dedup, Jaccard join, and their words."""

from __future__ import annotations

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from loomdex.llm import jaccard, spm, substring, words
from loomdex.llm.shared import components, forest

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, h long, path string, rep string, size int, component string, n int, a int, sig string, word string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [None, "", " ", "one", "tab\tand\nline  two ", "▁ x", "日本語 テスト 😀", "a" * 3000, "\0 z", "<s> </s> <0x41>", LONG]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 0, "", "", 0, "", 0, 0, "", "") for i, t in rows], EXTRA)


def sentences(rng, n, k=40, vocabulary=400):
    return [" ".join(rng.choice(vocabulary, k).astype(str)) for _ in range(n)]


# ---------------------------------------------------------------- words
@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x1fab é\xa0", max_size=40)), max_size=6))
def test_word_hashes(texts):
    h, offsets = words.word_hashes(texts)
    split = [t.encode().split() if t else [] for t in texts]
    assert np.diff(offsets).tolist() == [len(s) for s in split]
    flat = [w for s in split for w in s]
    assert len({*zip(flat, h.tolist(), strict=True)}) == len(set(flat)) == len(set(h.tolist()))


def test_words_longer_than_a_chunk():
    texts = ["x" * (words.CHUNK + 5) + " tail", "tail " + "y" * 10]
    h, offsets = words.word_hashes(texts)
    assert offsets.tolist() == [0, 2, 4] and h[1] == h[2]


@pytest.mark.parametrize("k", [5, 13])
def test_windows_of_short_texts(k):
    h, offsets = words.word_hashes([" ".join(map(str, range(30)))])
    want, _ = words.windows(h, offsets, k)
    for n in range(k + 2):
        short, whole = words.windows(h[:n], np.array([0, n]), k)
        assert whole.tolist() == [True] * max(0, n - k + 1) + [False] * min(n, k - 1)
        assert short[whole].tolist() == want[: max(0, n - k + 1)].tolist()


def test_partitions_of_one_short_text(spark):
    rows = [(n, " ".join(f"w{i}" for i in range(n))) for n in range(14)] + [(20, "w0 w1"), (21, " ".join(f"w{i}" for i in range(13)))]
    d = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    assert max(d.rdd.glom().map(len).collect()) == 1
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(d).collect()}
    assert got == substring.brute(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(d).collect()} == brute(rows)


# ---------------------------------------------------------------- SentencePiece
def test_pieces_are_the_library_s():
    p, rng = spm.Piecer(), random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(" ▁a\tbé日😀\n.1 <>s/") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    for text, said in zip(texts, p.encode(texts), strict=True):
        ids = p.sp.encode(text)
        assert said == ",".join(map(str, ids))
        a, b = p.spans(text, np.array(ids, np.int64))
        for q, begin, end in zip(p.sp.encode(text, return_type="proto").pieces, a, b, strict=True):
            assert p.sp.is_byte(q.id) or (q.begin, q.end) == (begin, end)


def test_compiled_character_map():
    n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    model, rules = pb.ModelProto(), pb.ModelProto()
    with open(spm.public_tokenizers.path(spm.MODEL), "rb") as f:
        model.ParseFromString(f.read())
    rules.ParseFromString(n.serialized_model_proto())
    model.normalizer_spec.CopyFrom(rules.normalizer_spec)
    g = spm.Piecer(proto=model.SerializeToString())
    rng = random.Random(2)
    texts = ["ｆｕｌｌ　ｗｉｄｔｈ ﬁ ①  ½ ", "Å é​ x", "", "  a  "] + ["".join(rng.choice(" ▁aﬁé日½①　\n") for _ in range(rng.randint(0, 20))) for _ in range(300)]
    for text in texts:
        assert g.normalise(text)[0].decode() == g.sp.normalize(text), repr(text)
        ids = np.array(g.sp.encode(text), np.int64)
        for q, begin, end in zip(g.sp.encode(text, return_type="proto").pieces, *g.spans(text, ids), strict=True):
            assert g.sp.is_byte(q.id) or (q.begin, q.end) == (begin, end)


def test_piece_tables(spark):
    d = table(spark, [*enumerate(ODD), (3, "one")])
    p = spm.Piecer()
    got = spm.digests(d).collect()
    assert len(got) == len(ODD) + 1 and all(r.spans_tile for r in got)
    for r in got:
        text = ODD[r.doc_id] or ""
        ids = p.sp.encode(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(p.sp.decode(ids).encode()).hexdigest())
    encoded = spm.encode(d.where("doc_id < 8"))
    back = {r.doc_id: r.text for r in spm.decode(encoded).collect()}
    assert back[4] == p.sp.decode(p.sp.encode(ODD[4])) and back[0] == ""
    assert spm.digests(d.limit(0)).count() == 0


# ---------------------------------------------------------------- substrings
@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, (1 << 28) - 1), unique=True, max_size=200), st.booleans())
def test_packed_slots(numbers, dense):
    slots = np.array(sorted(n % 5000 if dense else n for n in numbers), np.int64)
    slots = np.unique(slots)
    assert substring.unpack_slots(substring.pack_slots(slots)).tolist() == slots.tolist()


def test_sketch_never_underestimates(spark):
    rng = np.random.default_rng(3)
    texts = sentences(rng, 60)
    texts += [texts[i][5:] for i in range(20)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for bits in (12, 16):
        bitmap = np.frombuffer(substring.sketch(d, bits), np.uint8)
        h, offsets = words.word_hashes(texts)
        w, whole = words.windows(h, offsets, 13, 1)
        w = w[whole]
        _, inverse, count = np.unique(w, return_inverse=True, return_counts=True)
        assert substring.estimated_repeated(w[count[inverse] > 1], bitmap, bits).all()


@pytest.mark.parametrize("held", [200, 3_000_000])
def test_substrings_against_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(substring, "HELD", held)
    rng = np.random.default_rng(4)
    base = sentences(rng, 30, 60)
    passage = " ".join(rng.choice(500, 30).astype(str))
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 5]) for i in range(10)]  # copies
    rows += [(200 + i, f"{base[i]} {passage} {base[(i + 7) % 30][:50]}") for i in range(25)]  # one passage in many
    rows += [(300, ("la " * 40).strip()), (301, ("la " * 14).strip()), (400, None), (401, ""), (402, "a b c"), (403, LONG), (404, LONG + " end"), (-5, passage)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(table(spark, rows).repartition(4)).collect()}
    assert got == substring.brute(rows)


def test_substring_edges(spark):
    twice = table(spark, [(1, LONG), (1, LONG), (None, LONG)])
    assert [r.n_removed for r in substring.digests(twice).collect()] == [0, 0, 0]
    assert substring.digests(table(spark, [(0, "x")]).limit(0)).count() == 0
    assert substring.deduplicate(twice).columns[: len(twice.columns)] == twice.columns


# ---------------------------------------------------------------- components
def test_components(spark):
    rng = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(0, 300)]
    star = [(1000, i) for i in range(1001, 1400)]
    some = [tuple(map(int, rng.integers(2000, 2600, 2))) for _ in range(350)]
    edges = chain + star + some + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert components(df.limit(0)).count() == 0
    a, b = forest(np.array([3, 2, 9]), np.array([2, 1, 8]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(2, 1), (3, 1), (9, 8)]


# ---------------------------------------------------------------- Jaccard
def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    s = {d: shingles(t) for d, t in rows}
    links = [(a, b) for a, b in combinations(sorted(s), 2) if s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.8]
    count = dict.fromkeys(s, 0)
    component = {d: d for d in s}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(component[a], component[b])
            changed |= component[a] != low or component[b] != low
            component[a] = component[b] = low
    return {d: (component[d], count[d]) for d in s}


def near_copies(rng, text, n, edits):
    out = []
    for _ in range(n):
        w = text.split()
        for at in rng.choice(len(w), edits, replace=False):
            w[at] = f"z{rng.integers(1 << 30)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("tile", [2048, 32])
def test_jaccard_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = np.random.default_rng(6)
    base = sentences(rng, 40, 100, 5000)
    rows = list(enumerate(base))
    rows += [(100 + i, t) for i, t in enumerate(near_copies(rng, base[0], 90, 1))]  # a large group: all are linked
    rows += [(300 + i, t) for i, t in enumerate(near_copies(rng, base[1], 20, 2) + near_copies(rng, base[2], 20, 3))]  # about at the threshold
    rows += [(400 + i, base[3]) for i in range(30)]  # copies
    rows += [(500, None), (501, ""), (502, "a b"), (503, "a b"), (504, "a  b\n"), (505, "c"), (506, LONG), (507, LONG + " x"), (508, "")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(table(spark, rows).repartition(3)).collect()}
    assert got == brute(rows)
    kept = {r.doc_id for r in jaccard.keep_one(table(spark, rows)).collect()}
    assert kept == {d for d, (c, _) in brute(rows).items() if d == c}


def test_jaccard_edges(spark):
    d = table(spark, [(1, base := " ".join(map(str, range(30)))), (1, base), (None, base), (2, base)])
    got = sorted((r.doc_id or 0, r.n_links, r.kept) for r in jaccard.join(d).collect())
    assert got == [(0, 0, True), (1, 2, True), (1, 2, True), (2, 2, False)]
    kept = jaccard.keep_one(d)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1] and kept.columns == d.columns
    assert jaccard.join(d.limit(0)).count() == 0


def test_runs_reach_the_recall():
    n = jaccard.runs_for(0.999, 6)
    assert 1 - (1 - jaccard.survival(6)) ** n >= 0.999 > 1 - (1 - jaccard.survival(6)) ** (n - 1)
    # a pair that agrees in four of five coordinates meets as often as that says
    rng, met, tries = np.random.default_rng(7), 0, 300
    for k in range(tries):
        a = rng.integers(0, 60000, jaccard.COORDINATES).astype(np.uint16)
        b = np.where(rng.random(jaccard.COORDINATES) < 0.8, a, a + 1).astype(np.uint16)
        p, r = words.mix(np.arange(1 + 5 * k, 6 + 5 * k, dtype=np.uint64)), np.zeros(5, np.int64)
        q, s = p, r
        for _ in range(3):
            p, r = jaccard.children(p, r, a[None])
            q, s = jaccard.children(q, s, b[None])
        met += bool(set(p.tolist()) & set(q.tolist()))
    assert met / tries >= 1 - (1 - jaccard.survival(3)) ** 5 - 0.08
