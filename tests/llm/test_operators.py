"""Each operator against brute force on small odd tables: nulls, empty and long texts, repeated rows, clashing column names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallybrook.llm import chat, hmm, iblt, jaccard, mixing, pieces, quality, sharding, suffix, vptree

#: Names that operators use inside or return; the odd tables have them all as columns.
CLASH = ["id", "n", "h", "v", "t", "key", "bucket", "rn", "score", "predicted", "shard", "slot", "node", "c", "spans", "start", "held", "doc", "repeat_spans", "mix_epoch", "prefix", "__h", "__may", "__score", "__l0", "__s", "__n", "__k", "__t", "__repeat_hash"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def words(rng, n, pool=None):
    return " ".join(rng.choice(pool) if pool else "".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 7))) for _ in range(n))


def odd_rows():
    rng = random.Random(3)
    base = [words(rng, rng.randint(5, 120)) for _ in range(20)]
    passage = words(rng, 110)
    texts = [None, "", " \n\t", "one", "Two words", *base, base[0], base[1], base[1], base[2] + " end", base[3].upper()]
    texts += [f"{words(rng, 20)} {passage} {words(rng, 20)}" for _ in range(3)] + ["ab " * 900, words(rng, 6000), "größe ▃ 漢字 🙂\n" * 30, "x" * 1500]
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"src{i % 3}") for i, t in enumerate(texts)]
    rows += [(None, base[4], "en", "src0"), (2, "", "en", "src1"), rows[10], rows[10]]
    return [(*r, len(r[1] or ""), *["clash"] * len(CLASH)) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


# ---- quality ----


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    good = [(i, words(rng, 40)) for i in range(60)]
    bad = [(100 + i, words(rng, 40).upper() + "!!!") for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + bad] + [(None, 1, 0), (5000, 0, 0), (3, None, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    out = quality.classify(docs, labels.filter("doc_id % 2 = 0")).filter("doc_id % 2 = 1").collect()
    assert np.mean([r.predicted == (r.doc_id < 100) for r in out]) > 0.95


def test_quality_of_odd_rows(odd, empty, labelled):
    docs, labels = labelled
    out = quality.classify(odd, labels.limit(0)).collect()
    assert len(out) == len(odd_rows()) and {r.score for r in out} == {0.5}
    model = quality.fit(docs, labels)
    got = odd.withColumn("score", quality.score(odd, model)).collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if not r.text} == {float(model.labels.mean())}
    assert quality.classify(empty, labels).count() == 0


def test_quality_sample_is_bounded(labelled):
    docs, labels = labelled
    assert len(quality.fit(docs, labels, max_rows=7).labels) <= 7


# ---- fingerprints ----


def cells(x):
    return Counter(re.findall(iblt.CELL, x.encode().decode("latin-1")))


def alike(a, b):
    a, b = cells(a), cells(b)
    return (a & b).total() / (a | b).total() if a or b else 1.0


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_fingerprints(spark, odd, empty, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        check_fingerprints(odd, empty)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def check_fingerprints(odd, empty):
    rows = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in odd_rows()))
    out = iblt.fingerprints(odd, sketches=True).collect()
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9), len(r.only_own), len(r.only_edited)) for r in out)
    want = Counter()
    for i, (known, doc, text) in enumerate(rows):
        k, after = len(text) // 4, rows[(i + 1) % len(rows)][2]
        edited = text[: len(text) - k] + after[:k]
        want[(doc if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(alike(text, edited), 9), round(alike(text, after), 9), (cells(text) - cells(edited)).total(), (cells(edited) - cells(text)).total())] += 1
    assert got == want
    texts = {r[1] or "" for r in odd_rows()}
    assert len({r.fingerprint for r in out}) == len({frozenset(cells(t).items()) for t in texts})
    assert iblt.fingerprints(empty).count() == 0


def test_likeness_survives_lengths_and_insertions(spark):
    rng = random.Random(4)
    prose = words(rng, 700)
    texts = [prose[:520], prose[:510], prose[:1400], "z" + prose[:1400], prose[:3000], prose[:1500]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in iblt.fingerprints(df).collect()}
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        assert got[i].near_next == pytest.approx(alike(t, after)) and got[i].near_edited == pytest.approx(alike(t, t[: len(t) - len(t) // 4] + after[: len(t) // 4]))
    assert got[0].near_next > 0.6 and got[2].near_next > 0.8 and got[4].near_next > 0.4 and all(r.near_edited > 0.3 for r in got.values())


def test_a_lone_document_follows_itself(spark):
    r = iblt.fingerprints(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1.0


def test_likeness_of_texts_too_large_to_peel(spark):
    texts = ["\n".join(f"{k}{i:07d}" for i in range(25000)) for k in "ab"] + ["\n".join(f"c{i:07d}" for i in range(m, m + 300)) for m in (0, 150)]
    got = {r.doc_id: r for r in iblt.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        after = texts[(i + 1) % 4]
        assert got[i].near_edited == pytest.approx(alike(t, t[: len(t) - len(t) // 4] + after[: len(t) // 4]))
        assert got[i].near_next == pytest.approx(alike(t, after))


# ---- mixing ----


def test_mixing(odd, empty):
    weights = {"en": 3, "en/src1": 2}
    out = mixing.mix(odd, ("lang", "source"), weights, budget_share=1.2, max_epochs=2, seed=1)
    rows = out.collect()
    assert out.columns == [*(c for c in odd.columns if c != "mix_epoch"), "mix_tokens", "mix_epoch", "mix_take", "mix_budget"]
    leaves, budgets = Counter(), {}
    for r in odd_rows():
        leaves[(r[2] or "(none)", r[3] or "(none)")] += len(tokens(r[1]))
    total = int(sum(leaves.values()) * 1.2)

    def fill(budget, children):  # children: (name, cap, weight)
        out, rest = {}, sorted(children, key=lambda c: (c[1] / c[2], c[0]))
        while rest and rest[0][1] * sum(c[2] for c in rest) <= budget * rest[0][2]:
            out[rest[0][0]] = rest[0][1]
            budget -= rest.pop(0)[1]
        return out | {n: budget * w // sum(c[2] for c in rest) for n, _, w in rest}

    langs = {k[0] for k in leaves}
    top = fill(total, [(g, 2 * sum(v for k, v in leaves.items() if k[0] == g), weights.get(g, 1)) for g in langs])
    for g in langs:
        budgets |= {(g, s): b for s, b in fill(top[g], [(k[1], 2 * v, weights.get(f"{g}/{k[1]}", 1)) for k, v in leaves.items() if k[0] == g]).items()}
    took = Counter()
    for r in rows:
        leaf = (r.lang or "(none)", r.source or "(none)")
        assert r.mix_budget == budgets[leaf]
        took[leaf] += r.mix_take
    assert all(took[leaf] == budgets[leaf] for leaf in leaves if leaves[leaf])
    assert sum(budgets.values()) <= total and max(r.mix_epoch for r in rows) <= 1
    assert mixing.mix(empty, ("lang", "source"), weights).count() == 0


def test_shortages_stay_among_siblings(spark):
    docs = spark.createDataFrame([(i, "a " * 10, d, s) for i, (d, s) in enumerate([("x", "small")] + [("x", "big")] * 20 + [("y", "only")] * 20)], "doc_id long, text string, domain string, source string")
    got = {(r.domain, r.source): r.mix_budget for r in mixing.mix(docs, ("domain", "source"), {}, budget=200, max_epochs=1).collect()}
    assert got == {("x", "small"): 10, ("x", "big"): 90, ("y", "only"): 100}


# ---- chat ----


def test_rotation(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo <|x|>"), (1, 2, "bob", "yo <|x|>"), (1, 3, "ann", None), (2, 0, "system", "alone"), (None, 0, None, "?"), (3, 0, "user", "a"), (3, 300, "user", "b")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (None, "unknown", 0), (3, "user", 0)}
    r = got[(1, "ann", 0)]
    assert r.rendered == "<|system|>be<|end|>\n<|assistant|>hi<|end|>\n<|user name=bob|>yo < |x|><|end|>\n<|assistant|><|end|>\n"
    assert [r.rendered[s.start : s.end] for s in r.mask] == ["hi<|end|>\n", "<|end|>\n"] and (r.n_turns, r.n_own) == (4, 2)
    parts = sorted(chat.rotate(df, part_messages=1).filter("conv_id = 1 and perspective = 'ann'").collect(), key=lambda r: r.part)
    assert "".join(x.rendered for x in parts) == r.rendered and [x.part_base for x in parts] == [sum(len(y.rendered) for y in parts[:i]) for i in range(4)]
    hot = spark.createDataFrame([(None, None, f"p{i % 2}", f"m{i % 90}") for i in range(300)] + [(7, 300 * i, "p", f"{i}") for i in range(30)], df.schema.names[:4])
    every = chat.rotate(hot, part_messages=25).collect()
    assert Counter((x.conv_id, x.perspective, x.n_turns) for x in every) == {(None, "p0", 25): 3, (None, "p0", 15): 1, (None, "p1", 25): 3, (None, "p1", 15): 1, (7, "p", 25): 1, (7, "p", 5): 1}
    late = "".join(x.rendered for x in sorted(every, key=lambda x: x.part) if x.conv_id == 7)
    assert late == "".join(f"<|assistant|>{i}<|end|>\n" for i in range(30))
    assert chat.rotate(df.limit(0)).count() == 0


# ---- language model ----


def test_hmm(spark, odd, empty):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    got = hmm.score(odd, held, seed=1).collect()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for r in odd_rows() if not out(r[0]) for w in [*tokens(r[1]), "\n"])
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), out(r[0]), len(tokens(r[1])) + 1, sum(c[w] > 0 for w in [*tokens(r[1]), "\n"]), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*tokens(r[1]), "\n"]), 5)) for r in odd_rows())
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert hmm.score(empty, held).count() == 0
    assert all(math.isfinite(r.score) and r.train_tokens == 0 for r in hmm.score(odd, F.lit(True)).collect())


def test_forward_sums_all_paths_and_training_helps():
    rng = np.random.default_rng(0)
    seqs = [np.array([*rng.integers(1, 4, 5), 0], np.int16) for _ in range(3)] + [np.array([2, 0], np.int16)]
    model = hmm.Hmm.seeded(seqs, 1)
    order = sorted(range(4), key=lambda i: -len(seqs[i]))
    got = model.forward([seqs[i] for i in order])[0]
    s = seqs[3]
    total = sum(model.start[a] * model.emit[s[0], a] * model.move[a, b] * model.emit[s[1], b] for a, b in itertools.product(range(hmm.STATES), repeat=2))
    assert got[order.index(3)] == pytest.approx(math.log(total))
    counts = model.expected(seqs)
    assert counts[: hmm.STATES].sum() == pytest.approx(4) and counts[hmm.STATES + hmm.STATES**2 :].sum() == pytest.approx(sum(map(len, seqs)))
    better = hmm.Hmm.from_counts(counts).forward([seqs[i] for i in order])[0].sum()
    assert better > got.sum()


def test_every_round_trains_on_all_texts(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh" if i % 2 else "stuvwxyz") for _ in range(rng.randint(1, 9))) for i in range(3000)] + ["rare pair"] * 2
    got = {r.doc_id: r.score for r in hmm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.lit(False), seed=1).collect()}
    c = Counter(w for t in texts for w in t.split())
    signed = lambda w: int(np.array(hmm.xxhash.xxh3_64_intdigest(w), np.uint64).view(np.int64))
    number = {w: i + 1 for i, w in enumerate(sorted(c, key=lambda w: (-c[w], signed(w))))}
    seqs = [np.array([*(number[w] for w in t.split()), 0], np.int16) for t in texts]
    model = hmm.Hmm.seeded(seqs, 1)
    for _ in range(hmm.ROUNDS):
        model = hmm.Hmm.from_counts(model.expected(seqs))
    c["\n"] = len(texts)
    for i in (0, 1, 2, 3000):
        word = sum(math.log10((c[w] + 0.5) / (c[w] + 1)) for w in [*texts[i].split(), "\n"])
        assert got[i] == pytest.approx(word + model.forward([seqs[i]])[0][0] / math.log(10), abs=1e-5)


# ---- sharding ----


def test_interleaving(odd, empty):
    rows = sharding.interleave(odd, 4, ties=("text",)).collect()
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == {0, 1, 2, 3} and max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == len(odd_rows())
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for source, n in Counter(r.source for r in rows).items():
        for s in sizes:
            assert abs(sum(r.source == source and r.shard == s for r in rows) - n / 4) <= 2
    assert sharding.interleave(empty, 4).count() == 0
    assert sorted(r.shard for r in sharding.interleave(odd.limit(1), 4).collect()) == [0]


# ---- nearest neighbours ----


def test_neighbour_ties_go_to_smaller_ids(spark, monkeypatch):
    """Scaled copies of a vector tie, also across leaves and shards; huge and tiny vectors have cosines too."""
    monkeypatch.setattr(vptree, "LEAF", 8)
    rng = np.random.default_rng(2)
    v = rng.integers(-9, 9, 6).astype(float)
    rows = [(0, (3 * v).tolist())] + [(i, (v * 2.0 ** (i % 7)).tolist()) for i in range(39, 0, -1)]
    rows += [(100 + i, rng.normal(size=6).tolist()) for i in range(50)] + [(200, (v * 2.0**600).tolist()), (201, (v * 2.0**-600).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shards in (1, 4):
        got = vptree.neighbours(df, df.filter("vec_id in (0, 201)"), 5, 1.0, shards=shards).orderBy("query_id", "rank").collect()
        assert [(r.vec_id, round(r.score, 12)) for r in got] == [(i, 1.0) for i in (1, 2, 3, 4, 5)] + [(i, 1.0) for i in (0, 1, 2, 3, 4)]


def test_recall_at_the_factor_of_the_query(spark):
    from tallybrook.llm.queries import ANN_FACTOR

    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    queries = vectors.filter("vec_id % 50 = 0")
    found, exact = ({(r.query_id, r.vec_id) for r in vptree.neighbours(vectors, queries, 5, f, shards=2).collect()} for f in (ANN_FACTOR, 1.0))
    assert len(found & exact) / len(exact) >= 0.9


def test_neighbours_are_exact_at_factor_one(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(600, 8)).astype(np.float32).tolist()
    v[5] = v[6] = v[7] = v[8]
    rows = list(enumerate(v)) + [(600, None), (601, [0.0] * 8), (602, [float("nan")] * 8), (603, [None] + [1.0] * 7), (604, [float("inf")] * 8), (None, v[0]), (3, v[3])]
    df = spark.createDataFrame([(i, x, "clash") for i, x in rows], "vec_id long, embedding array<float>, id string")
    monkeypatch.setattr(vptree, "LEAF", 16)
    got = vptree.neighbours(df, df.filter("vec_id % 50 = 5 or vec_id = 601"), 5, 1.0, shards=3).collect()
    x = np.array(v, np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(5, 600, 50):
        s = u @ u[q]
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in mine] == want and [r.score for r in mine] == pytest.approx(s[want].tolist(), abs=1e-12)
    assert {r.query_id for r in got} == set(range(5, 600, 50))
    assert vptree.neighbours(df.limit(0), df.limit(0)).count() == 0
    assert vptree.neighbours(df.filter("vec_id in (1, 2)"), df.filter("vec_id = 1"), 5).count() == 1


# ---- repeated strings ----


def repeats_by_brute_force(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    return [suffix.merge_spans((i, i + length) for i in range(len(b) - length + 1) if seen[b[i : i + length]] > 1) for b in raw]


@pytest.mark.parametrize("large", [suffix.LARGE, 3000])
def test_repeated_strings_of_two_lengths(odd, large):
    rows = odd_rows()
    some, none = suffix.repeated(odd, length=400, large=large, shorter=256)
    got = sorted((str(r.doc_id), r.text or "", [tuple(s) for s in r.repeat_spans], [tuple(s) for s in r.passage_spans]) for r in [*some.collect(), *none.collect()])
    texts = [r[1] for r in rows]
    assert got == sorted((str(r[0]), r[1] or "", a, b) for r, a, b in zip(rows, repeats_by_brute_force(texts, 400), repeats_by_brute_force(texts, 256), strict=True))


def test_what_is_not_promising_holds_no_repeat():
    rng, dropped = random.Random(5), 0
    text = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    for length in (96, 200):
        for _ in range(40):
            gram = text(32)
            shared, parts = text(rng.randint(40, 300)), []
            for _ in range(rng.randint(2, 8)):
                cut = rng.randint(0, len(shared))
                own = shared if rng.random() < 0.5 else text(len(shared))
                parts.append(text(rng.randint(0, 90)) + own[:cut] + gram * rng.choice([1, 1, 1, 2]) + own[cut:] + text(rng.randint(0, 90)))
            v = suffix.grams(np.frombuffer(gram, np.uint8)).view(np.int64)[0]
            good = suffix.promising([*parts, b"z" * 150], [int(v)] * len(parts) + [1], [1] * (len(parts) + 1), length)
            strings = [[p[i : i + length] for i in range(len(p) - length + 1) if gram in p[i : i + length]] for p in parts]
            seen = Counter(x for own in strings for x in own)
            assert all(g for g, own in zip(good, strings) if any(seen[x] > 1 for x in own))
            dropped += int((~good).sum())
    assert dropped > 20


def test_only_what_segments_share_is_merged(monkeypatch):
    rng, merged = random.Random(7), []
    text = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    gram, shared, inner = text(32), text(200), suffix.repeats
    monkeypatch.setattr(suffix, "repeats", lambda parts, *rest: merged.extend(parts) or inner(parts, *rest))
    v = int(suffix.grams(np.frombuffer(gram, np.uint8)).view(np.int64)[0])
    pair = [text(300) + shared + gram + shared + text(300) for _ in range(2)]
    rows = [(v, b"a", pair[0], 700, 1), (v, b"b", pair[1], 700, 1), (v + 1, b"c", text(500), 101, 2)]  # the last one occurs twice as a whole
    got = pd.concat(suffix._merged([256, 400])(iter([pd.DataFrame(rows, columns=["v", "s", "seg", "run", "n"])])))
    spans = {(s, w): suffix.merge_spans((x["start"], x["end"]) for x in xs) for s, w, xs in got.itertuples(index=False)}
    assert spans == {(b"a", 0): [(300, 732)], (b"b", 0): [(300, 732)], (b"a", 1): [(300, 732)], (b"b", 1): [(300, 732)], (b"c", 0): [(0, 356)], (b"c", 1): [(0, 500)]}
    assert len(merged) == 2 and sum(map(len, merged)) <= 2 * (432 + 2 * 31)


def test_words_of_the_longest_run(spark):
    df = spark.createDataFrame([("one two three four", [(0, 3), (5, 18)]), ("one two", [(0, 7)]), (None, []), ("ab cd", [(3, 5)])], "t string, s array<struct<start:int,end:int>>")
    assert [r.n for r in df.select(suffix.longest_run("t", "s").alias("n")).collect()] == [2, 2, 0, 1]


@pytest.mark.parametrize("large", [suffix.LARGE, 3000])
def test_repeated_strings(odd, empty, large):
    some, none = suffix.repeated(odd, length=400, large=large)
    got = sorted((str(r.doc_id), r.text or "", [tuple(s) for s in r.repeat_spans]) for r in [*some.collect(), *none.collect()])
    rows = odd_rows()
    want = sorted((str(r[0]), r[1] or "", s) for r, s in zip(rows, repeats_by_brute_force([r[1] for r in rows], 400), strict=True))
    assert got == want and any(w[2] for w in want)
    left = some.select("text", "repeat_spans", suffix.kept("text", "repeat_spans").alias("k")).collect()
    assert all(len(r.k) == len((r.text or "").encode()) - sum(s.end - s.start for s in r.repeat_spans) for r in left)
    assert sum(df.count() for df in suffix.repeated(empty)) == 0


def test_merged_transforms_find_all_repeats(monkeypatch):
    rng = random.Random(1)
    for _ in range(60):
        monkeypatch.setattr(suffix, "SHARD", rng.choice([30, 100, 10**6]))
        length = rng.choice([9, 12, 33])
        pool = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(4)] + [b"ab" * 40]
        parts = [b"".join(rng.choice(pool) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 9))]
        counts, runs = [rng.choice([1, 1, 2]) for _ in parts], [rng.randint(1, len(p)) for p in parts]
        for longer, found in zip((length, length + 7), suffix.repeats(parts, runs, counts, [length, length + 7]), strict=True):
            places = [range(min(own, len(p) - longer + 1)) for p, own in zip(parts, runs, strict=True)]
            seen = Counter()
            for p, n, at in zip(parts, counts, places, strict=True):
                for i in at:
                    seen[p[i : i + longer]] += n
            want = {j: s for j, (p, at) in enumerate(zip(parts, places, strict=True)) if (s := suffix.merge_spans((i, i + longer) for i in at if seen[p[i : i + longer]] > 1))}
            assert {k: suffix.merge_spans(v) for k, v in found} == want


# ---- similarity join ----


def test_tokens_go_back_in_a_row_for_many_sets():
    texts = [(i, i, " ".join(f"w{x}" for x in range(i, i + 60))) for i in range(200)]
    batch = pa.record_batch([pa.array(c) for c in zip(*texts, strict=True)], names=["key", "id", "t"])
    cut = pd.concat([b.to_pandas() for b in jaccard._cut(5, 6)(iter([batch]))]).sort_values("range", kind="stable")
    got = pd.concat(jaccard._counted(6, 2)(iter([cut])))
    blocks = got[got["tokens"].notna()]
    assert len(got) - len(blocks) == 200 and len(blocks) <= 2 * 64
    sizes = Counter()
    for part, keys, many in blocks[["part", "keys", "many"]].itertuples(index=False):
        keys = jaccard.unflat(keys, np.int64)
        assert (jaccard.part_of(keys, 2) == part).all()
        sizes.update(dict(zip(keys.tolist(), jaccard.unflat(many, np.uint32).tolist(), strict=True)))
    assert sizes[100] == 56 and sizes[0] == 55 and set(sizes) == set(range(200))  # the first text has a shingle of its own



def components_by_brute_force(rows):
    def grams(text):
        w = tokens(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    ids = {}
    for r in rows:
        if r[0] is not None:
            ids.setdefault(r[0], []).append(grams(r[1]))
    up = {i: i for i in ids}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, b in itertools.combinations(sorted(ids), 2):
        if any(100 * len(x & y) >= 75 * len(x | y) > 0 for x in ids[a] for y in ids[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, grams


def test_similarity_join(spark, odd, empty):
    rng = random.Random(5)
    base = words(rng, 60).split()
    near = []
    for i in range(25):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = "new"
        near.append((1000 + i, " ".join(w)))
    chain = [(2000 + i, " ".join(base[i * 2 : i * 2 + 50])) for i in range(5)]
    rows = [(r[0], r[1]) for r in odd_rows()] + near + chain
    df = spark.createDataFrame([(*r, *["clash"] * len(CLASH)) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH))
    got = jaccard.join(df).collect()
    want, grams = components_by_brute_force(rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == Counter((i, len(grams(t)), want[i]) for i, t in rows if i is not None)
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(None, None)]
    assert jaccard.join(empty).count() == 0


# ---- pieces ----


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


@pytest.mark.parametrize("cut", [20.0, 0.3])
def test_samples_follow_the_lattice(vocabulary, monkeypatch, cut):
    """Also where nearly all branches are queued in sets, which must then be split."""
    import sentencepiece

    monkeypatch.setattr(pieces, "CUT", cut)
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    known = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}

    def ways(t):
        if not t:
            yield (), 0.0
        for j in range(1, len(t) + 1):
            if t[:j] in known:
                for rest, w in ways(t[j:]):
                    yield (known[t[:j]], *rest), w + vocabulary.weight[known[t[:j]]]

    all_ways = dict(ways("▁on▁the"))
    z = math.log(sum(map(math.exp, all_ways.values())))
    n, first, weight = 3000, Counter(), 0.0
    rows, ids, bounds = pieces.sample(pieces.Store(vocabulary), ["on the"] * n, list(range(n)), 3)
    seen = {}
    for i, (text, s, size, logp, _, inclusion) in enumerate(rows):
        way = tuple(ids[bounds[i] : bounds[i + 1]].tolist())
        assert len(way) == size and logp == pytest.approx(all_ways[way] - z)
        seen.setdefault(text, set()).add(way)
        first[way] += s == 0
        weight += math.exp(logp - inclusion)
    assert all(len(s) == 3 for s in seen.values())
    assert weight / n == pytest.approx(1, abs=0.05)
    pairs, p = Counter(frozenset(w for w in s) for s in seen.values()), {w: math.exp(x - z) for w, x in all_ways.items()}
    chance = lambda o: math.prod(p[w] / (1 - sum(p[u] for u in o[:j])) for j, w in enumerate(o))
    for ways_ in pairs.most_common(4):
        assert ways_[1] / n == pytest.approx(sum(map(chance, itertools.permutations(ways_[0]))), abs=0.03)
    top = max(all_ways, key=all_ways.get)
    assert first[top] / n == pytest.approx(math.exp(all_ways[top] - z), abs=0.03)


def test_encoding_and_decoding(odd, empty, vocabulary):
    out = pieces.encode(odd, vocabulary, 2, seed=1, texts=True)
    rows = out.withColumn("back", pieces.decode(out, vocabulary)).collect()
    texts = {str(r[0]) if r[0] is not None else "": r[1] or "" for r in odd_rows() if r[0] != 2}
    for r in rows:
        if r.key in texts:
            assert r.back == r.decoded == texts[r.key] and r.n_pieces == len(r.ids) and r.log_inclusion <= 1e-9
    assert Counter(r.sample for r in rows)[0] == len(odd_rows())
    assert all(r.n_pieces == 0 for r in rows if r.key == "1")
    long = [r for r in rows if r.key == "10"]
    assert len({(r.sample, tuple(r.ids)) for r in long}) == 2  # repeated rows get the same samples
    assert pieces.encode(empty, vocabulary).count() == 0
