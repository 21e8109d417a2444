"""N-gram Jaccard join by chosen paths.

Documents are sets of word shingles; two are linked if their Jaccard similarity is at least THRESHOLD. Documents with equal
sets form a class and only its least doc_id takes part; nothing is lost by that. Each set is embedded as COORDINATES
min-hash values. A run starts with all sets in one node; a node samples on average 1 / THRESHOLD coordinates by a hash of its
path, and sets that share a sampled value go on to a common child, so that a linked pair is expected to share at least one child at every level.
The choice depends on the path alone, so a set finds its nodes of the next levels by itself, and only counts per node are
shuffled. Nodes with few sets are compared by brute force, on their min-hash values; larger ones are split further, and what is
still large at the greatest depth is taken as similar. Signatures are joined once per set, not once per node. That gives
candidate groups, in which exact similarities are then computed from the texts, by matrix products over tiles of bounded
size, whatever the estimates said. Only sets whose sizes allow the threshold meet in a tile: a group is split by classes of
size, and a class meets itself and the next one.

Runs are repeated until a pair of exactly the threshold's similarity meets in a node of the greatest depth with
probability TARGET_RECALL; more similar pairs, and pairs that stop earlier, do better. See runs_for().

A shingle is WORDS consecutive words; a shorter text has one shingle, all of its words. Null texts and texts without
words link with nothing and are classes of their own. Repeated rows count as documents of their own; a doc_id stands for one text. Rows with a null doc_id link with nothing and get a
null class. An empty table gives no rows. Other columns are not read by join(), and carried along by keep_one().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.shared import bounded, components, cut, forest, tidy
from loomdex.llm.words import mix, windows, word_hashes

WORDS = 5
THRESHOLD = 0.8
COORDINATES = 128
TARGET_RECALL = 0.999
#: Levels after which nodes are counted, and split or compared.
DEPTHS = (3, 6)
#: Sets in a node up to which it is compared by brute force.
SMALL = 64
#: Sets and shingles on each side of a tile.
TILE, TILE_SHINGLES = 2048, 1_000_000
_RNG = np.random.default_rng(20200101)
_A = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def survival(depth: int, mean: float = 1.0) -> float:
    """Probability that a branching process with this Poisson mean of children lives for depth levels."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-mean * q)
    return q


def runs_for(recall: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth)))


def shingle_sets(texts: list[str | None], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    h, offsets = word_hashes(texts)
    w, whole = windows(h, offsets, k, 3)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(w[a:b][whole[a:b]]))
        elif b > a:
            out.append(mix(np.array([windows(h[a:b], np.array([0, b - a]), int(b - a), 4 + int(b - a))[0][0]], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(s), 512):
        np.minimum(best, ((s[at : at + 512, None] * _A + _B) >> np.uint64(32)).min(0), out=best)
    return (mix(best) >> np.uint64(48)).astype(np.uint16)


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, d1, d2, sig): size, digest and min-hash values of each row's set."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for at in range(0, len(pdf), 256):
                for s in shingle_sets(pdf["text"].iloc[at : at + 256].tolist()):
                    d1, d2 = mix(s).sum(dtype=np.uint64), mix(s ^ _B[0]).sum(dtype=np.uint64)
                    rows.append((len(s), d1.view(np.int64), d2.view(np.int64), signature(s).tobytes() if len(s) else b""))
            out = pd.DataFrame(rows, columns=["n", "d1", "d2", "sig"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    bounded(docs.sparkSession)
    part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return part.mapInPandas(tidy(run), "doc_id long, n long, d1 long, d2 long, sig binary")


def children(paths: np.ndarray, rows: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paths one level on, and the row of sigs that each belongs to. A node samples Poisson(1 / THRESHOLD) coordinates."""
    draw = (mix(paths) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    mean = 1 / THRESHOLD
    term = total = math.exp(-mean)
    count = np.zeros(len(paths), np.int64)
    for k in range(1, 12):
        count += draw >= total
        term *= mean / k
        total += term
    p, r = np.repeat(paths, count), np.repeat(rows, count)
    nth = (np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
    at = (mix(p ^ (nth + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(COORDINATES)
    value = sigs[r, at.astype(np.int64)].astype(np.uint64)
    return mix(p + (at << np.uint64(20)) + value + (nth << np.uint64(40)) + np.uint64(1)), r


def _sigs(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(-1, COORDINATES)


def first_paths(reps: DataFrame, runs: int, depth: int) -> DataFrame:
    """(path, rep) of the nodes at this depth, of all runs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                sigs = _sigs(part)
                p = np.tile(mix(np.arange(1, runs + 1, dtype=np.uint64)), len(part))
                r = np.repeat(np.arange(len(part)), runs)
                for _ in range(depth):
                    p, r = children(p, r, sigs)
                yield pd.DataFrame({"path": p.view(np.int64), "rep": part["rep"].to_numpy()[r]})

    return reps.select("rep", "sig").mapInPandas(tidy(run), "path long, rep long")


def next_paths(nodes: DataFrame, levels: int) -> DataFrame:
    """(path, rep) so many levels on. nodes: (rep, sig, paths array<long>)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                r = np.repeat(np.arange(len(part)), [len(x) for x in part["paths"]])
                p, sigs = np.concatenate(part["paths"].tolist()).astype(np.int64).view(np.uint64), _sigs(part)
                for _ in range(levels):
                    p, r = children(p, r, sigs)
                yield pd.DataFrame({"path": p.view(np.int64), "rep": part["rep"].to_numpy()[r]})

    return nodes.select("rep", "sig", "paths").mapInPandas(tidy(run), "path long, rep long")


def with_signatures(members: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, rep, sig) for members (node, rep): signatures come by one row per set, however many nodes it is in."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                n = [len(x) for x in part["nodes"]]
                yield pd.DataFrame({"node": np.concatenate(part["nodes"].tolist()).astype(np.int64), "rep": np.repeat(part["rep"].to_numpy(), n), "sig": np.repeat(part["sig"].to_numpy(), n)})

    each = members.groupBy("rep").agg(F.collect_list("node").alias("nodes"))
    return each.join(reps.select("rep", "sig"), "rep").select("rep", "sig", "nodes").mapInPandas(tidy(run), "node long, rep long, sig binary")


def _similar(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forest of the pairs of a node whose min-hash values agree often enough. Rows come node after node."""
    least = THRESHOLD - 6 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / COORDINATES)
    rest = None
    for pdf in frames:
        pdf = pdf if rest is None else pd.concat([rest, pdf])
        node = pdf["node"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(node)) + 1).tolist(), len(node)]
        rest = pdf.iloc[cuts[-2] :]
        yield _edges(pdf.iloc[: cuts[-2]], cuts[:-1], least)
    if rest is not None:
        yield _edges(rest, [0, len(rest)], least)


def _edges(pdf: pd.DataFrame, cuts: list[int], least: float) -> pd.DataFrame:
    a, b = [], []
    if len(pdf):
        sigs, reps = _sigs(pdf), pdf["rep"].to_numpy()
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            s = sigs[lo:hi]
            for i in range(hi - lo - 1):
                close = np.flatnonzero((s[i + 1 :] == s[i]).mean(1) >= least)
                a += [reps[lo + i]] * len(close)
                b += reps[lo + i + 1 + close].tolist()
    a, b = forest(np.array(a, np.int64), np.array(b, np.int64)) if a else (np.zeros(0, np.int64),) * 2
    return pd.DataFrame({"a": a, "b": b})


def candidates(reps: DataFrame, recall: float = TARGET_RECALL, depths: tuple[int, ...] = DEPTHS, small: int = SMALL) -> DataFrame:
    """(a, b): edges whose components hold every pair that met in a node and looked similar. reps: (rep, sig)."""
    paths, edges, at = first_paths(reps, runs_for(recall, depths[-1]), depths[0]), None, depths[0]
    for depth in [*depths[1:], None]:
        stats = paths.groupBy("path").agg(F.count("*").alias("size"), F.min("rep").alias("least")).where("size > 1")
        met = cut(paths.join(stats, "path"))
        lists = met.where(F.col("size") <= small).groupBy("path").agg(F.array_sort(F.collect_set("rep")).alias("members"))
        lists = lists.where(F.size("members") > 1).select("members").distinct()  # the same few meet in many runs
        members = lists.select(F.xxhash64("members").alias("node"), F.explode("members").alias("rep"))
        shown = with_signatures(members, reps).repartition("node").sortWithinPartitions("node", "rep")
        new = shown.mapInPandas(tidy(_similar), "a long, b long")
        large = met.where(F.col("size") > small)
        if depth is None:
            new = new.union(large.select(F.col("rep").alias("a"), F.col("least").alias("b")).where("a != b").distinct())
        else:
            each = large.groupBy("rep").agg(F.collect_list("path").alias("paths"))
            paths = next_paths(each.join(reps.select("rep", "sig"), "rep"), depth - at)
            at = depth
        new = cut(new)  # a level at a time: the driver holds the plan of one, and its shuffles can go
        edges = new if edges is None else edges.union(new)
    return edges


def exact(members: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(rep, n_links) and (a, b): counts of documents linked to each representative, and edges that connect what links connect.

    members: (rep, size, n, component) of candidate groups; docs: (doc_id, text)."""
    # sizes of linked sets are less than 1 / threshold times each other, so that their classes are equal or adjoin
    kind = F.floor(F.log(F.col("n").cast("double")) / math.log(1.0001 / threshold)).cast("int")
    need = lambda sets_, shingles: F.greatest(F.ceil(F.col(sets_) / TILE), F.ceil(F.col(shingles) / TILE_SHINGLES)).cast("int")
    members = members.withColumn("kind", kind)
    counted = cut(members.groupBy("component", "kind").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")))  # read six times below
    counted = counted.join(counted.groupBy("component").agg(F.sum("sets").alias("all"), F.sum("shingles").alias("all_shingles")), "component")
    # what fits in one tile is not split by size
    fits = need("all", "all_shingles") <= 1
    split = counted.where(~fits).select("component", "kind", need("sets", "shingles").alias("blocks"))
    beside = lambda by, name: split.select("component", (F.col("kind") + by).alias("kind"), F.col("blocks").alias(name))
    several = split.join(beside(1, "lower"), ["component", "kind"], "left").join(beside(-1, "upper"), ["component", "kind"], "left")
    several = several.select("component", "kind", F.col("kind").alias("at"), "blocks", F.coalesce("lower", F.lit(0)).alias("lower"), F.coalesce("upper", F.lit(0)).alias("upper"))
    one = counted.where(fits).select("component", "kind", F.lit(0).alias("at"), F.lit(1).alias("blocks"), F.lit(0).alias("lower"), F.lit(0).alias("upper"))
    m = members.join(several.union(one), ["component", "kind"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # tiles of a set: with each block of its own class, and with those of the classes beside; every pair of blocks has one
    tile = lambda low, i, j, nth: F.struct(low.alias("kind"), i.alias("i"), j.alias("j"), nth.alias("own"))
    every = lambda n, make: F.transform(F.slice(F.sequence(F.lit(0), n), F.lit(1), n), make)
    k, b = F.col("at"), F.col("block")
    own = every(F.col("blocks"), lambda x: tile(2 * k, F.least(b, x), F.greatest(b, x), F.when(b <= x, 0).otherwise(1)))
    above = every(F.col("upper"), lambda x: tile(2 * k + 1, b, x, F.lit(0)))
    below = every(F.col("lower"), lambda x: tile(2 * k - 1, x, b, F.lit(1)))
    # the rep's own text: one row per doc_id
    texts = docs.where("doc_id is not null").join(m.select(F.col("rep").alias("doc_id"), "component", "size", F.concat(own, above, below).alias("tiles")), "doc_id")
    dealt = texts.select("component", "doc_id", "size", "text", F.explode("tiles").alias("t")).select("component", "t.*", "doc_id", "size", "text")
    dealt = dealt.repartition("component", "kind", "i", "j").sortWithinPartitions("component", "kind", "i", "j", "doc_id")

    def done(keys: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        ids = np.array([r[0] for r in rows], np.int64)
        sizes, block = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])
        own = [r[3] for r in rows]
        lengths = np.array([len(s) for s in own], np.int64)
        everything = np.concatenate(own)
        row = np.repeat(np.arange(len(own)), lengths)
        order = np.argsort(everything, kind="stable")
        h, row = everything[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        column = np.cumsum(new) - 1
        often = np.bincount(column)[column] > 1
        column, row = column[often], row[often]
        column = np.cumsum(np.diff(column, prepend=-1) != 0) - 1
        # one block with itself, or two: of classes of size beside each other, or of the same
        alone = keys[1] % 2 == 0 and keys[2] == keys[3]
        left, right = (np.arange(len(ids)),) * 2 if alone else (np.flatnonzero(block == 0), np.flatnonzero(block == 1))
        counts, tree = np.zeros(len(ids), np.int64), (np.zeros(0, np.int64),) * 2
        width = int(max(64, min(2048, (8 << 20) // max(1, len(ids)))))
        shared = np.zeros((len(left), len(right)), np.float32)
        total = int(column[-1]) + 1 if len(column) else 0
        cuts = np.searchsorted(column, np.arange(0, total + width, width))
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            there = np.zeros((len(ids), width), np.float32)
            there[row[lo:hi], column[lo:hi] - k * width] = 1
            shared += there[left] @ there[right].T
        for at in range(0, len(left), 256):
            a = left[at : at + 256]
            part = shared[at : at + 256]
            linked = part / (lengths[a][:, None] + lengths[right][None, :] - part.astype(np.float64)) >= threshold
            i, j = np.nonzero(linked)
            i, j = a[i], right[j]
            if alone:
                i, j = i[i < j], j[i < j]
            np.add.at(counts, i, sizes[j])
            np.add.at(counts, j, sizes[i])
            if len(i):
                tree = forest(np.concatenate([tree[0], ids[i]]), np.concatenate([tree[1], ids[j]]))
        yield pd.DataFrame({"a": np.concatenate([ids[counts > 0], tree[0]]), "b": np.concatenate([np.full((counts > 0).sum(), -1), tree[1]]), "n": np.concatenate([counts[counts > 0], np.zeros(len(tree[0]), np.int64)])})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, seen = None, [], None
        for pdf in frames:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                tiles = zip(part["component"], part["kind"], part["i"], part["j"], strict=True)
                for tile_, d, size, side, s in zip(tiles, part["doc_id"], part["size"], part["own"], shingle_sets(part["text"].tolist()), strict=True):
                    if tile_ != key:
                        if len(held) > 1:
                            yield from done(key, held)
                        key, held, seen = tile_, [], None
                    if d != seen:  # repeated rows
                        held.append((d, size, side, s))
                        seen = d
        if len(held) > 1:
            yield from done(key, held)

    found = cut(dealt.mapInPandas(tidy(run), "a long, b long, n long"))
    return found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links")), found.where("n = 0").select("a", "b")


def join(docs: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, copy_of, kept), one row per row of docs.

    n_links: other documents with similarity >= THRESHOLD, equal ones included; class_id: the least doc_id reachable by
    links; copy_of: the least doc_id with the same shingles; kept: doc_id = class_id."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(sets(narrow))
    some = rows.where("n > 0")
    classes = some.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("sig").alias("sig"))
    classes = cut(classes)
    groups = components(candidates(classes.select("rep", "sig"), recall))
    members = cut(classes.select("rep", "size", "n").join(groups.withColumnRenamed("node", "rep"), "rep"))
    counts, edges = exact(members, narrow)
    parts = components(edges)
    known = classes.join(counts, "rep", "left").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    known = known.select("d1", "d2", "n", "rep", (F.coalesce("n_links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("class_id"))
    out = some.drop("sig").join(known, ["d1", "d2", "n"]).select("doc_id", "class_id", "n_links", F.col("rep").alias("copy_of"))
    none = rows.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("copy_of"))
    lost = narrow.where("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("copy_of"))
    out = out.union(none).union(lost)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def keep_one(docs: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """docs without those that are not the least doc_id of their class; rows with a null doc_id stay. Of repeated rows of a kept document one stays."""
    gone = join(docs, recall).where("not kept").select(F.col("doc_id").alias("__jac_id")).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col("__jac_id"), "left_anti")
    return left.where("doc_id is not null").dropDuplicates(["doc_id"]).select(*docs.columns).union(left.where("doc_id is null").select(*docs.columns))


#: The same rows in DuckDB's SQL, by all shingles that two documents share.
SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as shingle from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b using (shingle) where a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b, shared = x.n and shared = y.n as same from p join n x on x.doc_id = a join n y on y.doc_id = b where shared >= 0.8 * (x.n + y.n - shared)),
r as (select doc_id as a, doc_id as b from w union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as class_id from r group by a),
m as (select a, count(*) as n_links, min(case when same then b end) as copy from l group by a)
select c.a as doc_id, c.class_id as class_id, coalesce(m.n_links, 0) as n_links, least(c.a, coalesce(m.copy, c.a)) as copy_of, coalesce(c.a = c.class_id, true) as kept
from c left join m on c.a = m.a
"""
