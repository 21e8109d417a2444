"""Registered queries over the smallest tables, whole, against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from loomdex.llm import registry, spm, substring

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


def rows(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def luhn(digits):
    return sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(digits))) % 10 == 0


def test_surrogates_change_entities_only(spark, documents):
    """Entities found again by plain patterns: what stands between them stays, equal ones stay equal, distinct ones distinct."""
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    found = re.compile(rf"[\w.]+@[\w-]+(?:\.[\w-]+)+|(?<![\d.])(?:{octet}\.){{3}}{octet}(?!\d|\.\d)|\+1 \(\d{{3}}\) \d{{3}}-\d{{4}}|(?<![\d.-])4\d{{15}}(?![\d-])|(?<=token = .)[0-9a-f]{{40}}")
    new, pairs = {r.doc_id: r for r in rows(spark, "op1_surrogates")}, set()
    assert len(new) == len(documents)
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        text = text or ""
        places = [m.span() for m in found.finditer(text) if not re.fullmatch(r"4\d{15}", m[0]) or luhn(m[0])]
        assert new[i].n_entities == len(places), (i, [text[a:b] for a, b in places])
        between = [text[a:b] for a, b in zip([0, *(e for _, e in places)], [*(s for s, _ in places), len(text)], strict=True)]
        m = re.fullmatch("(.+?)".join(re.escape(b) for b in between), new[i].text or "", re.S)
        assert m, i
        pairs |= {(text[a:b], g) for (a, b), g in zip(places, m.groups(), strict=True)}
    old, made = [p[0] for p in pairs], [p[1] for p in pairs]
    assert pairs and len(set(old)) == len(old) and len(set(made)) == len(made) and not set(old) & set(made)


def test_media(spark, documents):
    got = {r.doc_id: r for r in rows(spark, "op2_media_columns")}
    assert len(got) == len(documents)
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        data = (text or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_embeddings(spark):
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    v = np.stack(e.embedding.to_numpy()).astype(np.float64)
    fine = np.isfinite(v).all(1) & (np.abs(v).sum(1) > 0)
    u = np.where(fine[:, None], v, 1)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & fine[:, None] & fine[None, :]
    np.fill_diagonal(near, False)
    label = e.vec_id.to_numpy().copy()
    for _ in range(len(e)):
        new = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(1))
        if (new == label).all():
            break
        label = new
    got = {r.vec_id: r for r in rows(spark, "op3_pca_tiles")}
    assert {i: (int(n), int(c)) for i, n, c in zip(e.vec_id, near.sum(1), label, strict=True)} == {i: (r.n_links, r.component_id) for i, r in got.items()}


def test_language(spark, documents):
    got = {r.doc_id: r for r in rows(spark, "op4_byte_recurrent")}
    lang = dict(zip(documents.doc_id, documents.lang, strict=True))
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
    judged = [got[i].lang_pred == lang[i] for i in got if got[i].held_out and lang[i] is not None and got[i].lang_pred != "und"]
    assert len(judged) > 20 and np.mean(judged) > 0.9


def test_mix_sizes(spark, documents):
    got = {r.doc_id: r for r in rows(spark, "op5_curriculum_mix")}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in zip(documents.doc_id, documents.text, strict=True)}
    total = Counter()
    for i, s in zip(documents.doc_id, documents.source, strict=True):
        total[s] += size[i]
    assert {i: (r.size, r.source_size) for i, r in got.items()} == {i: (size[i], total[s]) for i, s in zip(documents.doc_id, documents.source, strict=True)}
    for s in total:
        own = [got[i] for i, t in zip(documents.doc_id, documents.source, strict=True) if t == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and own[0].target <= 3 * total[s] + 1e-6


def test_pieces(spark, documents):
    p = spm.Piecer()
    got = {r.doc_id: r for r in rows(spark, "op8_sentencepiece_spans")}
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        ids = p.sp.encode(text or "")
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(p.sp.decode(ids).encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want and got[i].spans_tile


def test_substrings(spark, documents):
    want = substring.brute(list(zip(documents.doc_id.tolist(), documents.text.tolist(), strict=True)))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows(spark, "op9_count_min_substrings")} == want


def test_jaccard(spark, documents):
    sets = {}
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        w = (text or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, links, label = sorted(sets), Counter(), {i: i for i in sets}
    edges = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                edges.append((a, b))
    for _ in ids:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.doc_id: (r.n_links, r.class_id) for r in rows(spark, "op10_chosen_path_join")} == {i: (links[i], label[i]) for i in ids}
