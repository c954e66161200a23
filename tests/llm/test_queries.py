"""Queries with SQL against DuckDB, and the pipeline's stages."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallybrook.llm.common import staged
from tallybrook.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


def test_there_is_a_query_for_each_operator():
    assert {q.split("_")[0] for q in QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("n_chars", F.col("n_chars"))
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "src1", 0)], docs.schema)
    now, counts = docs.unionByName(odd), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = staged(stage(spark, now, SF), name)
        counts.append(out.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        now = out
    assert 150 < counts[0] < 202 and counts[1] < counts[0] and counts[2] == counts[1] and 0 < counts[3] <= counts[2] and counts[4] > counts[3]


def test_stages_equal_brute_force(spark):
    """near_duplicates and repeated_strings over the whole small table, with copies and a long text added."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = [tuple(r) for r in docs.collect()]
    long = next(r for r in given if r[1] and len(r[1]) > 3000)
    given += [(9001, long[1][: len(long[1]) // 2], "en", "src1", 1), (9002, long[1] + " end", "en", "src1", 1), (9003, None, "en", None, 0), (9004, "", None, "src1", 0), (None, "no id", "en", "src1", 5), (9005, long[1] * 20, "de", "src2", 1)]
    docs = spark.createDataFrame(given, docs.schema)
    sets = {}
    for doc, text, *_ in given:
        w = (text or "").encode().lower().split()
        if doc is not None:
            sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    name = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and name[a] != name[b]:
                lo, hi = sorted((name[a], name[b]))
                name = {d: lo if c == hi else c for d, c in name.items()}
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(d) for d, *_ in given if d is None or name[d] == d)
    seen, width = {}, 400
    raw = [(r.doc_id, (r.text or "").encode()) for r in kept]
    for _, t in raw:
        for i in range(len(t) - width + 1):
            seen[t[i : i + width]] = seen.get(t[i : i + width], 0) + 1
    want = {}
    for doc, t in raw:
        drop = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                drop[i : i + width] = b"\1" * width
        want[doc] = bytes(c for c, d in zip(t, drop, strict=True) if not d).decode(errors="ignore")
    got = corpus_pipeline.repeated_strings(spark, staged(spark.createDataFrame(kept, docs.schema), "kept"), SF).collect()
    assert {r.doc_id: r.text or "" for r in got} == want and any(len(want[r.doc_id]) < len(r.text or "") for r in kept)


@pytest.mark.parametrize("i", range(5))
def test_stages_of_nothing(spark, i):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[i][1](spark, docs, SF).count() == 0


def test_repeated_passages_under_400_bytes(spark):
    """The pipeline's stage also removes repeated strings of 256 bytes with over 50 words, held against brute force; shorter passages stay."""
    words = lambda n, k: " ".join(f"{k}{i}" + "abc"[: 1 + i % 3] for i in range(n))
    passage, fewer, long = words(55, "p"), words(20, "q") + "x" * 200, words(90, "r")
    texts = [f"{words(30, 'a')} {passage} {words(9, 'b')}", f"{words(12, 'c')} {passage}", f"{fewer} {words(40, 'd')}", f"{words(40, 'e')} {fewer}", f"{long} {words(3, 'f')}", f"é {long}", "", None]
    assert 256 <= len(passage) < 400 and 256 <= len(fewer) < 400 <= len(long)
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    raw = [(t or "").encode() for t in texts]

    def spans(width):
        seen = {}
        for t in raw:
            for i in range(len(t) - width + 1):
                seen[t[i : i + width]] = seen.get(t[i : i + width], 0) + 1
        for t in raw:
            at = [i for i in range(len(t) - width + 1) if seen[t[i : i + width]] > 1]
            yield [(a, b + width) for a, b in zip([i for i in at if i - 1 not in at], [i for i in at if i + 1 not in at], strict=True)]

    want = {}
    for d, (t, strings, passages) in enumerate(zip(raw, spans(400), spans(256), strict=True)):
        gone = strings + [(a, b) for a, b in passages if len(t[a:b].split()) > 51]
        want[d] = bytes(c for i, c in enumerate(t) if not any(a <= i < b for a, b in gone)).decode(errors="ignore")
    stage = dict(corpus_pipeline.STAGES)["repeated_strings"]
    got = stage(spark, staged(docs, "given"), SF).collect()
    assert {r.doc_id: r.text or "" for r in got} == want and all(r.n_chars == len(r.text or "") for r in got)
    assert passage not in "".join(want.values()) and want[2] == texts[2] and want[3] == texts[3] and "r50" not in want[4]
