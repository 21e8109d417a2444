"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in stretches of SEGMENT bytes, forwards and backwards, each with up to CONTEXT
bytes of the text before and after it, labels every byte position with a probability per language, and the document's
probabilities are the mean over its positions. It is trained here in numpy by backpropagation through time.

Training uses text and lang of a bounded sample: of each language at most PER_LANG documents whose crc32(doc_id) mod 5
is not 0, those with the least keyed hash over the whole table, and of each a few stretches; shorter texts are a stretch
of their own, padded, and what is padded does not count. Languages without any text to learn from are not predicted.
lang, source and doc_id are never inputs of a prediction. Every byte of every text is labelled.

A text that is null or has no letter is "und" with score 0, as is every text if no labelled row may be learned from.
Rows are independent: repeated rows and ties get equal results (of equal probabilities the first language in code point order wins); columns other than those
named are not read by predict() and carried along unread by keep_known().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.shared import bounded, give_back, tidy

#: Bytes read as one sequence, in training and in prediction.
SEGMENT = 64
#: Bytes on either side of a stretch that are read with it in prediction, so that no position lacks what stands next to it.
CONTEXT = 16
HIDDEN = 8
PER_LANG = 400
#: Languages beyond so many are an error: the sample is bounded by it.
MOST_LANGS = 400
STEPS, BATCH, RATE = 220, 384, 0.03
#: Sequences run side by side in prediction.
WIDE = 4096


@dataclass
class Model:
    langs: list[str]
    #: Per direction: byte table (3H, 256), recurrent weights (3H, H); then output weights (K, 2H) and bias (K, 1).
    tables: list[np.ndarray] = field(default_factory=list)
    recurrent: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    bias: np.ndarray | None = None


def _run(x: np.ndarray, counts: list[int], table: np.ndarray, u: np.ndarray, back: bool) -> np.ndarray:
    """States (T, H, B) of one direction. x: bytes (T, B), longest sequences first; counts[t] of them reach past t.

    Gates: z, r = sigmoid, as (tanh + 1) / 2 of halved sums; n = tanh(x_n + r * (U_n h)); h = n + z (h - n).
    """
    steps, wide = x.shape
    hidden = u.shape[1]
    half = np.concatenate([np.full((2 * hidden, 1), 0.5, np.float32), np.ones((hidden, 1), np.float32)])
    table, u = table * half, u * half
    out = np.zeros((steps, hidden, wide), np.float32)
    h = np.zeros((hidden, wide), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        n = counts[t]
        if not n:
            continue
        g = table.take(x[t, :n], axis=1)
        a = u @ h[:, :n]
        zr = g[: 2 * hidden]
        zr += a[: 2 * hidden]
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        new = a[2 * hidden :]
        new *= zr[hidden:]
        new += g[2 * hidden :]
        np.tanh(new, out=new)
        part = h[:, :n]
        part -= new
        part *= zr[:hidden]
        part += new
        out[t, :, :n] = part
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(0))
    return x / x.sum(0)


def probabilities(model: Model, x: np.ndarray, counts: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(t, n, probabilities (K, n)) for each position t of the n sequences that reach it."""
    states = [_run(x, counts, model.tables[d], model.recurrent[d], bool(d)) for d in (0, 1)]
    hidden = model.recurrent[0].shape[1]
    for t, n in enumerate(counts):
        if n:
            yield t, n, _softmax(model.out[:, :hidden] @ states[0][t, :, :n] + model.out[:, hidden:] @ states[1][t, :, :n] + model.bias)


def _segments(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and of each stretch, longest first: begin and length with its context, text, and where its own positions
    begin and end within it."""
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    base = np.cumsum(sizes) - sizes
    each = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(raw)), each)
    own = (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)) * SEGMENT
    begin = np.maximum(own - CONTEXT, 0)
    length = np.minimum(own + SEGMENT + CONTEXT, sizes[doc]) - begin
    first = own - begin
    last = first + np.minimum(SEGMENT, sizes[doc] - own)
    order = np.argsort(-length, kind="stable")
    return np.frombuffer(b"".join(raw) + bytes(SEGMENT + 2 * CONTEXT), np.uint8), (base[doc] + begin)[order], length[order], doc[order], first[order], last[order]


def _positions(model: Model, segments: tuple) -> Iterator[tuple[slice, int, int, np.ndarray, np.ndarray]]:
    """(stretches, position, how many of them reach it, which of those own it, probabilities (K, n)), some stretches at a time."""
    data, begin, length, _, first, last = segments
    for at in range(0, len(begin), WIDE):
        part = slice(at, at + WIDE)
        b, n = begin[part], length[part]
        x = data[np.arange(n[0])[:, None] + b[None, :]]
        counts = [int(np.searchsorted(-n, -t, side="left")) for t in range(n[0])]
        for t, c, p in probabilities(model, x, counts):
            yield part, t, c, (first[part][:c] <= t) & (t < last[part][:c]), p


def pooled(model: Model, texts: list[str]) -> np.ndarray:
    """Mean probabilities of each text's positions, (texts, K); zeros for an empty text."""
    raw = [t.encode() for t in texts]
    segments = _segments(raw)
    sums = np.zeros((len(model.langs), len(segments[1])))
    for part, _, c, own, p in _positions(model, segments):
        sums[:, part.start : part.start + c] += p * own
    total = np.stack([np.bincount(segments[3], s, len(texts)) for s in sums], 1)
    return total / np.maximum(1, [len(r) for r in raw])[:, None]


def fit(sample: list[tuple[str, str]], seed: int = 5, hidden: int = HIDDEN, steps: int = STEPS) -> Model:
    """A model of (text, lang) pairs; Adam on the cross-entropy of every position, each language equally often."""
    langs = sorted({lang for text, lang in sample if text})
    rng = np.random.default_rng(seed)
    model, k = Model(langs), len(langs)
    if k == 0:
        return model
    f32 = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    params = [f32(3 * hidden, 256, scale=0.3), f32(3 * hidden, 256, scale=0.3), f32(3 * hidden, hidden, scale=0.4), f32(3 * hidden, hidden, scale=0.4), f32(k, 2 * hidden, scale=0.3), np.zeros((k, 1), np.float32)]
    model.tables, model.recurrent, model.out, model.bias = params[:2], params[2:4], params[4], params[5]
    pieces = [[] for _ in langs]
    for text, lang in sample:
        raw = text.encode()
        if raw:
            for at in range(0, max(1, len(raw) - SEGMENT + 1), SEGMENT):
                pieces[langs.index(lang)].append(raw[at : at + SEGMENT])
    if k == 1:
        return model
    sizes = [np.array([len(b) for b in p]) for p in pieces]
    pieces = [np.array([np.frombuffer(b.ljust(SEGMENT), np.uint8) for b in p]) for p in pieces]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(steps):
        kinds = rng.integers(0, k, BATCH)
        chosen = [rng.integers(len(pieces[c])) for c in kinds]
        x = np.stack([pieces[c][at] for c, at in zip(kinds, chosen, strict=True)]).T.copy()
        grads = _gradients(model, x, kinds, np.array([sizes[c][at] for c, at in zip(kinds, chosen, strict=True)]))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * step / steps))
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads)))
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            g *= min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-6)
    return model


def _gradients(model: Model, x: np.ndarray, kinds: np.ndarray, sizes: np.ndarray | None = None) -> list[np.ndarray]:
    """Gradients of the mean over sequences of the mean cross-entropy of their positions, in the order of fit()'s
    parameters. sizes: of each sequence the number of positions that count; all do if it is not given."""
    steps, wide = x.shape
    sizes = np.full(wide, steps) if sizes is None else sizes
    inside = (np.arange(steps)[:, None] < sizes).astype(np.float32)
    hidden = model.recurrent[0].shape[1]
    kept = []
    for d in (0, 1):
        table, u = model.tables[d], model.recurrent[d]
        h, trace = np.zeros((hidden, wide), np.float32), []
        for t in range(steps - 1, -1, -1) if d else range(steps):
            g, a = table.take(x[t], axis=1), u @ h
            zr = 1 / (1 + np.exp(-(g[: 2 * hidden] + a[: 2 * hidden])))
            z, r = zr[:hidden], zr[hidden:]
            n = np.tanh(g[2 * hidden :] + r * a[2 * hidden :])
            trace.append((t, h, z, r, n, a[2 * hidden :]))
            h = (n + z * (h - n)) * inside[t]  # backwards, a sequence begins at its last position that counts
        kept.append((trace, [tr[1] for tr in trace[1:]] + [h]))
    hs = np.zeros((steps, 2 * hidden, wide), np.float32)
    for d, (trace, after) in enumerate(kept):
        for tr, h in zip(trace, after, strict=True):
            hs[tr[0], d * hidden : (d + 1) * hidden] = h
    logits = model.out @ hs + model.bias
    logits = np.exp(logits - logits.max(1, keepdims=True))
    delta = logits / logits.sum(1, keepdims=True)
    delta[:, kinds, np.arange(wide)] -= 1
    delta *= (inside / (sizes * wide).astype(np.float32))[:, None, :]
    grad_out = np.einsum("tkb,thb->kh", delta, hs)
    grad_bias = delta.sum((0, 2))[:, None]
    into = model.out.T @ delta
    tables, recurrent = [], []
    for d, (trace, _) in enumerate(kept):
        u = model.recurrent[d]
        gt, gu, back = np.zeros((3 * hidden, 256), np.float32), np.zeros_like(u), np.zeros((hidden, wide), np.float32)
        for t, h, z, r, n, an in reversed(trace):
            back = (back + into[t, d * hidden : (d + 1) * hidden]) * inside[t]
            dn = back * (1 - z) * (1 - n * n)
            dz = back * (h - n) * z * (1 - z)
            dr = dn * an * r * (1 - r)
            dg = np.concatenate([dz, dr, dn])
            da = np.concatenate([dz, dr, dn * r])
            for row in range(3 * hidden):
                gt[row] += np.bincount(x[t], dg[row], 256).astype(np.float32)
            gu += da @ h.T
            back = back * z + u.T @ da
        tables.append(gt)
        recurrent.append(gu)
    return [*tables, *recurrent, grad_out.astype(np.float32), grad_bias.astype(np.float32)]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, per_lang: int = PER_LANG, stretch: int = 1024, seed: int = 11) -> list[tuple[str, str]]:
    """At most per_lang (text, lang) pairs of each language, texts being stretches of at most this many characters from
    a keyed place; rows are chosen over the whole table by the least keyed hash, without ordering it."""
    open_rows = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    open_rows = open_rows.select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in open_rows.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    key = F.xxhash64(F.lit(seed), F.col("doc_id")) / F.lit(2.0**64) + 0.5
    # so many are expected below the bound that fewer than per_lang are rare; then all that there are serve
    below = [(F.col("lang") == lang) & (key < min(1.0, (per_lang + 4 * per_lang**0.5) / n)) for lang, n in counts.items()]
    if not below:
        return []
    chosen = below[0]
    for b in below[1:]:
        chosen = chosen | b
    room = F.greatest(F.length("text") - stretch, F.lit(0))
    at = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), room + 1).cast("int") + 1
    rows = open_rows.where(chosen).select("lang", key.alias("k"), "doc_id", F.substring(F.col("text"), at, F.lit(stretch)).alias("text")).collect()
    out, seen = [], dict.fromkeys(counts, 0)
    for r in sorted(rows, key=lambda r: (r["k"], r["doc_id"], r["text"])):
        if seen[r["lang"]] < per_lang:
            seen[r["lang"]] += 1
            out.append((r["text"], r["lang"]))
    return out


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    return fit(sample(docs, per_lang))


def _predictor(model: Model):
    def run(texts: pd.Series) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for at in range(0, len(texts), 512):
            part = [t or "" for t in texts[at : at + 512]]
            if len(model.langs) < 2:
                langs += [model.langs[0] if model.langs else "und"] * len(part)
                scores += [1.0 if model.langs else 0.0] * len(part)
                continue
            p = pooled(model, part)
            best = p.argmax(1)
            langs += [model.langs[b] for b in best]
            scores += np.clip(p[np.arange(len(part)), best], 0, 1).tolist()
        return langs, scores

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with __lang_pred and __lang_score."""
    bounded(docs.sparkSession)
    run = _predictor(model)
    schema = "__lang_pred string, __lang_score double"

    @F.pandas_udf(schema)
    def label(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for texts in frames:
                langs, scores = run(texts)
                yield pd.DataFrame({"__lang_pred": langs, "__lang_score": scores})
        finally:
            give_back()

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    d = docs.withColumn("__lang", label(F.when(letters, F.col("text")).otherwise(F.lit(""))))
    d = d.withColumns({"__lang_pred": F.when(letters, F.col("__lang.__lang_pred")).otherwise("und"), "__lang_score": F.when(letters, F.col("__lang.__lang_score")).otherwise(0.0)})
    return d.drop("__lang")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of docs."""
    d = scored(docs.select("doc_id", "text"), model)
    return d.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__lang_score").alias("score"))


def keep_known(docs: DataFrame, model: Model, least: float = 0.35) -> DataFrame:
    """docs without those that are "und" or whose best language has a pooled probability below least."""
    d = scored(docs, model)
    return d.where((F.col("__lang_pred") != "und") & (F.col("__lang_score") >= least)).select(*docs.columns)


def label_positions(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, runs array<struct<start, end, lang>>): stretches of bytes with the same likeliest language."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for text in pdf["text"]:
                raw = (text or "").encode()
                labels = np.zeros(len(raw), np.int64)
                if len(model.langs) > 1:
                    segments = _segments([raw])
                    for part, t, c, mine, p in _positions(model, segments):
                        labels[segments[1][part][:c][mine] + t] = p[:, mine].argmax(0)
                cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(raw)] if len(raw) and model.langs else [0]
                out.append([{"start": a, "end": b, "lang": model.langs[labels[a]]} for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "runs": out})

    bounded(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(tidy(run), "doc_id long, runs array<struct<start:long,end:long,lang:string>>")
