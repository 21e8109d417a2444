"""The pipeline's stages, each on its own input, and the registered queries."""

from __future__ import annotations

import random
import re
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from loomdex.llm import registry, spm

SF = "/root/testdata/sf0.001"
SYLLABLES = {"en": ["the", "ing", "on"], "de": ["sch", "ung", "ei"], "fr": ["eau", "é", "ou"]}
MAIL = "jo.do7@corp.com"


def fixture(spark, folder):
    rng = random.Random(9)

    def prose(lang, n=60):
        return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(2, 5))) for _ in range(n))

    rows = []
    for i in range(150):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, prose(lang), lang, f"s{i % 4}"))
    rows += [(200 + i, rows[i][1] + " end", rows[i][2], "s1") for i in range(10)]  # near copies
    rows += [(300 + i, f"{prose('en')} {MAIL} {prose('en')}", "en", "s2") for i in range(5)]
    rows += [(400, None, "en", "s0"), (401, "123 !!", "en", "s0"), (402, "", None, None)]
    d = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return {r[0]: r for r in rows}


def test_stages(spark, tmp_path):
    rows = fixture(spark, tmp_path)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    ids = {n: [r.doc_id for r in d.select("doc_id").collect()] for n, d in seen.items()}
    assert set(ids["language"]) == set(rows) - {400, 401, 402}
    assert set(ids["near_duplicates"]) == set(ids["language"]) - {200 + i for i in range(10)}
    assert sorted(ids["surrogates"]) == sorted(ids["near_duplicates"])
    texts = {r.doc_id: r for r in seen["surrogates"].collect()}
    assert all(texts[i].text == rows[i][1] for i in range(150))
    assert all(MAIL not in texts[i].text and re.search(r"\w+\.\w+@\w+\.example\.\w+", texts[i].text) and texts[i].n_chars == len(texts[i].text) for i in range(300, 305))
    mixed = seen["mix"].collect()
    size = {r.doc_id: len(r.text.split()) for r in texts.values()}
    total = {s: sum(size[i] for i in texts if rows[i][3] == s) for s in ("s0", "s1", "s2", "s3")}
    weights = {"s0": 5, "s1": 2, "s2": 1, "s3": 5}
    for s in total:
        assert abs(sum(len(r.text.split()) for r in mixed if r.source == s) - sum(total.values()) * weights[s] / 13) <= 1
    p = spm.Piecer()
    assert sorted(r.n_tokens for r in seen["pieces"].collect()) == sorted(len(p.sp.encode(r.text)) for r in mixed)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, seen["pieces"].collect()))


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(registry.SQL))
def test_queries_with_sql(spark, name):
    same_as_sql(spark, name, SF, ("documents", "embeddings", "conversations", "pages"))


def same_as_sql(spark, name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, str(folder)).toPandas(), con.sql(registry.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def rows(frame):
        return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))

    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["op3_pca_tiles", "op9_count_min_substrings", "op10_chosen_path_join"])
def test_sql_of_edges(spark, tmp_path, name):
    """Null, empty, short, blank-only and equal texts; null, zero, unfinished and shorter vectors."""
    one = " ".join(f"w{i}" for i in range(40))
    texts = [None, "", " \t\n", "a b", "a b", "b a", one, one, one + " more", "x " * 30, "x " * 31, f"{one}\u00a0é ü", "ä ö\x0bü " + one[:80], one.replace(" ", "  ")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [None, [], [0.0, 0.0], [1.0, None], [1.0, float("nan")], [float("inf"), 1.0], [1.0, 0.0], [2.0, 0.0], [1.0, 0.1], [1.0, 0.5], [1.0, 0.0, 0.0], [3.0, 0.0, 0.1], [-1.0, 0.0]]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = registry.QUERIES[name](spark, str(tmp_path)).collect(), con.sql(registry.SQL[name])
    assert sorted(tuple(r[c] for c in want.columns) for r in got) == sorted(want.fetchall())


def test_columns_of_queries():
    assert list(registry.QUERIES) == sorted(registry.QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n)[1])) and len(registry.QUERIES) == 10
