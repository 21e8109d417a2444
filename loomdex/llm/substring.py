"""Substring dedup behind a count-min prefilter.

A window is WINDOW consecutive words of one document. A word is removed if a window that covers it has the same words as
a window of a document with a smaller doc_id; windows are judged on the input.

First pass: every task counts its windows in a count-min sketch of two rows with saturating counters (0, 1, many), kept
sparse; the sketches of all tasks are merged by ranges of slots, in as many tasks as there are ranges. Estimates are
never too low, so a window estimated at one occurrence occurs once. Second pass: only windows estimated repeated are
grouped, exactly. Where several documents of one task share a window, all but the one with the least doc_id are settled
there, and one record per window and task is shuffled, with all its positions in that document, so that a window of a
third of all documents, or of a third of one text, sends a record per task. What is settled travels as runs of positions.

The merged sketch has a fixed largest size, 2 * 2^most_bits bits (64 MB by default), whatever the corpus; it is the only
thing broadcast. Beyond about 2^most_bits windows it passes more of them on, and results stay the same.

A null text has no words. Documents shorter than a window lose nothing. Rows with a null doc_id are left whole and
match nothing. Repeated rows (equal doc_id and text) do not remove each other and get equal results; a doc_id stands for
one text. Other columns are carried along by deduplicate().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.shared import bounded, give_back, tidy, written
from loomdex.llm.words import mix, windows, word_hashes

WINDOW = 13
MOST_BITS = 28
ROWS = 2
#: Windows that a task holds at once.
HELD = 1_500_000
_SALTS = (np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B))


def _slots(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(h ^ _SALTS[row]) >> np.uint64(64 - bits)


def pack_slots(slots: np.ndarray) -> bytes:
    """Ascending numbers as gaps of one byte each, 255 meaning 255 and more to come; or as 32-bit numbers where shorter."""
    if not len(slots):
        return b""
    gaps = np.diff(slots.astype(np.int64), prepend=0)
    n = gaps // 255 + 1
    ends = np.cumsum(n)
    if ends[-1] >= 4 * len(slots):
        return b"\0" + slots.astype("<u4").tobytes()
    out = np.full(ends[-1], 255, np.uint8)
    out[ends - 1] = gaps % 255
    return b"\1" + out.tobytes()


def unpack_slots(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    if data[0] == 0:
        return np.frombuffer(data, "<u4", offset=1).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, offset=1)
    return np.cumsum(raw, dtype=np.int64)[raw != 255]


def _batches(frames: Iterator[pd.DataFrame], k: int, size: int = 256) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for pdf in frames:
        for at in range(0, len(pdf), size):
            part = pdf.iloc[at : at + size]
            h, offsets = word_hashes(part["text"].tolist())
            first, whole = windows(h, offsets, k, 1)
            yield part, h, offsets, first, whole


def sketch(docs: DataFrame, bits: int, k: int = WINDOW) -> bytes:
    """Bitmaps, row after row, of the slots that hold more than one window. docs: (doc_id, text)."""
    shard_bits = min(6, bits - 3)
    width = bits - shard_bits

    def emit(held: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        h, out = np.concatenate(held), []
        for row in range(ROWS):
            slots = np.sort(_slots(h, row, bits).astype(np.int64))
            new = np.diff(slots, prepend=-1) != 0
            begins = np.flatnonzero(new)
            count = np.diff(np.append(begins, len(slots)))
            slots = slots[begins]
            cuts = np.searchsorted(slots, np.arange((1 << shard_bits) + 1) << width)
            for s in range(1 << shard_bits):
                part, n = slots[cuts[s] : cuts[s + 1]] - (s << width), count[cuts[s] : cuts[s + 1]]
                if len(part):
                    out.append((row << shard_bits | s, pack_slots(part[n == 1]), pack_slots(part[n > 1])))
        yield pd.DataFrame(out, columns=["shard", "once", "many"])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for _, _, _, w, whole in _batches(frames, k):
            held.append(w[whole])
            n += len(held[-1])
            if n > HELD:
                yield from emit(held)
                held, n = [], 0
        if n:
            yield from emit(held)

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, once, many = None, None, None
        for pdf in frames:
            for s, a, b in zip(pdf["shard"], pdf["once"], pdf["many"], strict=True):
                if s != shard:
                    if shard is not None:
                        yield pd.DataFrame({"shard": [shard], "bitmap": [np.packbits(many, bitorder="little").tobytes()]})
                    shard, once, many = s, np.zeros(1 << width, bool), np.zeros(1 << width, bool)
                got = unpack_slots(a)
                many[got[once[got]]] = True
                once[got] = True
                got = unpack_slots(b)
                many[got] = once[got] = True
        if shard is not None:
            yield pd.DataFrame({"shard": [shard], "bitmap": [np.packbits(many, bitorder="little").tobytes()]})

    parts = docs.mapInPandas(tidy(count), "shard int, once binary, many binary")
    merged = parts.repartition("shard").sortWithinPartitions("shard").mapInPandas(tidy(merge), "shard int, bitmap binary")
    return _bitmap(written(merged, "sketch"), ROWS << shard_bits, (1 << width) // 8)


def _bitmap(shards: DataFrame, count: int, size: int) -> bytes:
    """The bitmaps of so many shards of so many bytes, one after another; some are fetched at a time."""
    out, step = bytearray(count * size), max(1, (16 << 20) // size)
    for at in range(0, count, step):
        for r in shards.where(F.col("shard").between(at, at + step - 1)).collect():
            out[r["shard"] * size : (r["shard"] + 1) * size] = r["bitmap"]
    return bytes(out)


def estimated_repeated(h: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(h), bool)
    for row in range(ROWS):
        at = _slots(h, row, bits)
        base = row << (bits - 3)
        out &= (bitmap[base + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def repeated(docs: DataFrame, k: int = WINDOW, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, start, n): runs of n window positions that also start in a document with a smaller doc_id. docs: (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(min(most_bits, max(12, (size // 3).bit_length())))
    sent = spark.sparkContext.broadcast(sketch(docs, bits, k))

    def emit(held: list) -> Iterator[pd.DataFrame]:
        h, x, doc, at = (np.concatenate([b[i] for b in held]) for i in range(4))
        order = np.lexsort((at, doc, x, h))
        h, x, doc, at = h[order], x[order], doc[order], at[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
        begins = np.flatnonzero(new)
        open_ = doc == doc[begins][np.cumsum(new) - 1]
        d, start, n = runs(doc[~open_], at[~open_])
        yield pd.DataFrame({"h": mix(d.view(np.uint64)).view(np.int64), "x": start, "doc_id": d, "n": n.astype(np.int32), "more": None})
        # a window's places in its least document, the first in x and the others, which are few, in more
        counts = np.add.reduceat(open_.astype(np.int64), begins)
        more = np.full(len(begins), None, object)
        for i in np.flatnonzero(counts > 1).tolist():
            more[i] = at[begins[i] + 1 : begins[i] + counts[i]].astype("<i4").tobytes()
        yield pd.DataFrame({"h": h[begins].view(np.int64), "x": x[begins].astype(np.int64) << 32 | at[begins], "doc_id": doc[begins], "n": np.zeros(len(begins), np.int32), "more": more})

    def candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = np.frombuffer(sent.value, np.uint8)
        held, n = [], 0
        for part, h, offsets, w, whole in _batches(frames, k):
            second, _ = windows(h, offsets, k, 2)
            at = np.flatnonzero(whole)
            at = at[estimated_repeated(w[at], bitmap, bits)]
            row = np.searchsorted(offsets, at, side="right") - 1
            held.append((w[at], (second[at] >> np.uint64(33)).astype(np.uint32), part["doc_id"].to_numpy()[row], at - offsets[row]))
            n += len(at)
            if n > HELD // 2:
                yield from emit(held)
                held, n = [], 0
        if n:
            yield from emit(held)

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # the window that the batch before ended in, and its least doc_id
        for pdf in frames:
            n = pdf["n"].to_numpy()
            if (n > 0).any():
                yield pdf.loc[n > 0, ["doc_id", "x", "n"]].rename(columns={"x": "start"})
                pdf = pdf[n == 0]
            if not len(pdf):
                continue
            h, xs, doc = pdf["h"].to_numpy(), pdf["x"].to_numpy(), pdf["doc_id"].to_numpy()
            x, at, more = xs >> 32, xs & 0xFFFFFFFF, pdf["more"].to_numpy()
            order = np.lexsort((doc, x, h))
            h, x, doc, at, more = h[order], x[order], doc[order], at[order], more[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
            least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            if last is not None:
                same = (h == last[0]) & (x == last[1])
                least[same] = np.minimum(least[same], last[2])
            last = h[-1], x[-1], least[-1]
            again = doc > least
            if again.any():
                d, p, rest = doc[again], at[again], more[again]
                others = [i for i, m in enumerate(rest) if m is not None]
                extra = [np.frombuffer(rest[i], "<i4") for i in others]
                d = np.concatenate([d, np.repeat(d[others], [len(e) for e in extra])]) if others else d
                d, start, m = runs(d, np.concatenate([p, *extra]))
                yield pd.DataFrame({"doc_id": d, "start": start, "n": m})

    found = docs.mapInPandas(tidy(candidates), "h long, x long, doc_id long, n int, more binary")
    # sorted by all 96 bits of a window and by doc_id, so the least comes first even where a window spans batches
    dealt = found.repartition("h").sortWithinPartitions("h", F.shiftright("x", 32), "doc_id")
    return dealt.mapInPandas(tidy(settle), "doc_id long, start long, n int")


def runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first position, length) of the stretches of consecutive positions."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 1)
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(doc)) - 1
    return (doc[begins], at[begins], at[ends] - at[begins] + 1) if len(doc) else (doc, at, at)


def doc_filter(ids: DataFrame, most_bits: int = MOST_BITS) -> tuple[bytes, int]:
    """Bitmap of hashed doc_ids, of at most 2^most_bits bits: a document whose bit is unset is not among ids. ids: (doc_id), distinct."""
    bits = int(min(most_bits, max(12, (16 * ids.count()).bit_length())))
    shard_bits = min(6, bits - 3)
    width = bits - shard_bits

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            slots = np.unique(mix(pdf["doc_id"].to_numpy().view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.searchsorted(slots, np.arange((1 << shard_bits) + 1) << width)
            out = [(s, pack_slots(slots[a:b] - (s << width))) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            yield pd.DataFrame(out, columns=["shard", "slots"])

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, there = None, None
        for pdf in frames:
            for s, slots in zip(pdf["shard"], pdf["slots"], strict=True):
                if s != shard:
                    if shard is not None:
                        yield pd.DataFrame({"shard": [shard], "bitmap": [np.packbits(there, bitorder="little").tobytes()]})
                    shard, there = s, np.zeros(1 << width, bool)
                there[unpack_slots(slots)] = True
        if shard is not None:
            yield pd.DataFrame({"shard": [shard], "bitmap": [np.packbits(there, bitorder="little").tobytes()]})

    merged = ids.mapInPandas(emit, "shard int, slots binary").repartition("shard").sortWithinPartitions("shard").mapInPandas(tidy(merge), "shard int, bitmap binary")
    return _bitmap(written(merged, "doc-filter"), 1 << shard_bits, (1 << width) // 8), bits


def removed_words(words: int, found: np.ndarray, k: int) -> np.ndarray:
    """found: runs of windows, first position * 2^32 + number."""
    start, n = found >> 32, found & 0xFFFFFFFF
    gone = np.bincount(np.minimum(start, words), minlength=words + 1) - np.bincount(np.minimum(start + n + k - 1, words), minlength=words + 1)
    return np.cumsum(gone)[:-1] > 0


def deduplicate(docs: DataFrame, k: int = WINDOW, most_bits: int = MOST_BITS) -> DataFrame:
    """docs with __sub_text (kept words joined by one space), __sub_words and __sub_removed."""
    bounded(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = repeated(narrow, k, most_bits).groupBy(F.col("doc_id").alias("__sub_doc")).agg(F.collect_list(F.shiftleft("start", 32) + F.col("n")).alias("__sub_runs"))
    found = written(found, "runs")
    bitmap, bits = doc_filter(found.select(F.col("__sub_doc").alias("doc_id")))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def lookup(ids: pd.Series) -> np.ndarray:
        there = np.frombuffer(sent.value, np.uint8)
        at = mix(ids.fillna(0).to_numpy(np.int64).view(np.uint64)) >> np.uint64(64 - bits)
        return (there[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool) & ids.notna().to_numpy()

    @F.pandas_udf("boolean")
    def maybe(ids: pd.Series) -> pd.Series:
        return pd.Series(lookup(ids))

    part = "__sub_text string, __sub_words long, __sub_removed long"

    @F.pandas_udf(part)
    def whole(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        try:
            for ids, texts in frames:
                rows = []
                for other, text in zip(lookup(ids).tolist(), texts, strict=True):
                    parts = text.encode().split() if text and not other else []
                    rows.append((None, None, None) if other else (b" ".join(parts).decode(), len(parts), 0))
                out = pd.DataFrame(rows, columns=["__sub_text", "__sub_words", "__sub_removed"])
                yield out.astype({"__sub_words": "Int64", "__sub_removed": "Int64"})
        finally:
            give_back()

    @F.pandas_udf(part)
    def cut(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        try:
            for texts, spans in frames:
                rows = []
                for text, found in zip(texts, spans, strict=True):
                    parts = text.encode().split() if text else []
                    gone = removed_words(len(parts), np.zeros(0, np.int64) if found is None else np.asarray(found, np.int64), k)
                    rows.append((b" ".join([p for p, g in zip(parts, gone.tolist(), strict=True) if not g]).decode(), len(parts), int(gone.sum())))
                yield pd.DataFrame(rows, columns=["__sub_text", "__sub_words", "__sub_removed"])
        finally:
            give_back()

    # only texts that may lose words are shuffled; each stage has one Python step, so that few workers are up at a time
    narrow_id, words = F.col("doc_id").cast("long"), F.col("text").cast("string")
    joined = docs.where(maybe(narrow_id)).join(found, narrow_id == F.col("__sub_doc"), "left").withColumn("__sub", cut(words, F.col("__sub_runs")))
    rest = docs.withColumn("__sub", whole(narrow_id, words)).where("__sub.__sub_words is not null")
    return joined.select(*docs.columns, "__sub.*").unionByName(rest.select(*docs.columns, "__sub.*"))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of docs."""
    d = deduplicate(docs.select("doc_id", "text"))
    return d.select("doc_id", F.col("__sub_words").alias("n_words"), F.col("__sub_removed").alias("n_removed"), F.sha2(F.col("__sub_text").cast("binary"), 256).alias("kept_sha256"))


def brute(rows: list[tuple[int, str | None]], k: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """What digests() returns, by a table of all windows; for tests."""
    words = {d: (t.encode().split() if t else []) for d, t in rows}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - k + 1):
            first.setdefault(tuple(words[d][i : i + k]), d)
    out = {}
    for d, w in words.items():
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone[i : i + k] = True
        kept = b" ".join([x for x, g in zip(w, gone, strict=True) if not g])
        out[d] = len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()
    return out


#: The same rows in DuckDB's SQL, by all windows.
SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as words from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from w)),
f as (select words, min(doc_id) as least from g group by words),
c as (select distinct doc_id, unnest(range(i, i + 13)) as p from g join f using (words) where least < doc_id),
t as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from w),
k as (select doc_id, string_agg(word, ' ' order by p) as kept, count(*) as n from t anti join c using (doc_id, p) group by doc_id)
select w.doc_id as doc_id, cast(len(w.w) as bigint) as n_words, cast(len(w.w) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from w left join k on w.doc_id = k.doc_id
"""
