"""Byte-level BPE, the filter audit and ranked search against a library, brute force and odd tables."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tallybrook.llm import audit, bpe, ranked
from tests.llm.test_operators import SCHEMA, odd_rows, words

RANKS = bpe.load_ranks()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- byte-level BPE ----


@pytest.mark.parametrize("leaf,short", [(2, 2), (3, 4), (5, 2), (16, 8)])
def test_small_leaves_give_the_same_tokens(library, monkeypatch, leaf, short):
    monkeypatch.setattr(bpe, "LEAF", leaf)
    monkeypatch.setattr(bpe, "SHORT", short)
    rng, coder = random.Random(leaf), bpe.Coder(RANKS, public_tokenizers.PATTERN)
    for alphabet in ("ab '", "a", "  \n\t1", "'rlvesdtmx ", "aé漢字🙂  　", "the fox's don't  ", "abcdefghijklmnop", "0123456789", "!?.,;-_ "):
        for n in (0, 1, 2, 3, 5, 9, 17, 40, 100, 400):
            for _ in range(5):
                text = "".join(rng.choice(alphabet) for _ in range(n))
                ids = coder.encode(text)
                assert ids == library.encode_ordinary(text)
                assert coder.decode(ids) == text.encode()


def test_long_words(library):
    rng, coder = random.Random(1), bpe.Coder(RANKS, public_tokenizers.PATTERN)
    for text in ("a" * 9001, "ab" * 6000, "".join(rng.choice("abcdefgh") for _ in range(15000)), " " * 9000 + "x", "漢" * 7000):
        assert coder.encode(text) == library.encode_ordinary(text)


def test_short_words_of_a_block_are_merged_side_by_side(library, monkeypatch):
    rng, coder, alone = random.Random(3), bpe.Coder(RANKS, public_tokenizers.PATTERN), []
    monkeypatch.setattr(bpe, "KNOWN", 500)
    texts = ["".join(rng.choice("abcdeé漢 1.") for _ in range(rng.choice([0, 1, 50, 6000]))) for _ in range(40)]
    merge = coder.merge
    coder.merge = lambda raw: alone.append(raw) or merge(raw)
    assert coder.encode_all(texts) == [library.encode_ordinary(t) for t in texts]
    short = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 32))) for _ in range(400)]
    alone.clear()
    assert coder.encode_all(short) == [library.encode_ordinary(t) for t in short] and not alone


def test_token_that_merges_cannot_reach():
    ranks = {bytes([b]): b for b in range(256)} | {b"xyz": 256, b"ab": 257}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.Coder(ranks, public_tokenizers.PATTERN)
    for text in ("xyz", "xyzab", "xyz xyz", "abxyz", "xyzxyz"):
        assert coder.encode(text) == own.encode_ordinary(text)


def test_bpe_of_odd_rows(library, odd, empty):
    got = Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in bpe.encode_decode(odd, RANKS).collect())
    want = Counter((r[0], np.array(library.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in odd_rows())
    assert got == want
    assert bpe.encode_decode(empty, RANKS).count() == 0
    assert bpe.encode_decode(odd.selectExpr("text as ids", "cast(doc_id as string) as decoded", "n as key"), RANKS, key="decoded", text="ids").columns == ["decoded", "ids", "decoded"]


# ---- filters ----


def fails(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(found) < 100 else ""
    out += "B" if 100 * len(set(found)) < 80 * len(found) else ""
    out += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else ""
    return out + ("D" if re.search(r"[#$%&*|]", text) else "")


def audited(rows, labels):
    least, out = {}, Counter()
    for i, text, _ in rows:
        if i is not None:
            least[text] = min(least.get(text, i), i)
    for part in {p for _, _, p in rows}:
        masks = Counter((fails(t) + ("E" if i is not None and i > least[t] else ""), labels.get(i, (0, 0))) for i, t, p in rows if p == part)
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                letter, before = order[step - 1], set(order[: step - 1])
                facts = [0] * 7
                for (mask, (good, toxic)), n in masks.items():
                    bad, gone = letter in mask, bool(before & set(mask))
                    removed = bad and not gone
                    for x, told in enumerate((not bad and not gone, removed, bad and gone, mask == letter, removed and good == 1, removed and toxic == 1)):
                        facts[x] += n * bool(told)
                    facts[6] += n * 120 // len(mask) if bad else 0
                out[part, order, step, *facts] += 1
    return out


@pytest.mark.parametrize("bits,hot", [(64, 1000), (1, 1000), (64, 3)])
def test_audit(spark, odd, empty, monkeypatch, bits, hot):
    """Also with hashes that clash, and with keys that count as hot."""
    monkeypatch.setattr(audit, "HOT", hot)
    marks = [(0, 1, 0), (5, 1, 1), (6, 0, 1), (25, 1, 0), (26, 1, 0), (27, 0, 1), (27, None, 1), (None, 1, 1), (9999, 1, 1), (8, None, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    known = {0: (1, 0), 5: (1, 1), 6: (0, 1), 25: (1, 0), 26: (1, 0), 27: (0, 1)}
    got = Counter(tuple(r) for r in audit.audit(odd, labels, bits=bits).collect())
    assert got == audited([(r[0], r[1] or "", r[2] or "") for r in odd_rows()], known)
    assert audit.audit(empty, labels).count() == 0
    assert audit.audit(odd, labels.limit(0)).agg({"good_lost": "max"}).first()[0] == 0


def test_audit_of_one_large_group(spark):
    rows = [(i, "same text again", "en") for i in range(900)] + [(1000 + i, f"text {i}", "en") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    out = audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).filter("filter_order = 'EABCD' and step = 1").first()
    assert (out.removed, out.kept, out.unique_fails) == (899, 901, 0)


# ---- ranked search ----


def found(docs, items, k):
    split = lambda t: re.findall(ranked.TERM, (t or "").translate(str.maketrans(ranked.UPPER, ranked.LOWER)))
    counts = [(i, Counter(split(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms, df = len(counts), sum(sum(c.values()) for _, c in counts), Counter(w for _, c in counts for w in c)
    asked = {}
    for i, t in {(i, t) for i, t in items}:
        asked.setdefault(i, Counter()).update(split(t))
    out = Counter()
    for item, terms in asked.items():
        scores = []
        for doc, c in counts:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, x in terms.items() if w in c)
            scores.append((-s, doc is None, doc or 0, doc))
        for rank, (s, _, _, doc) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1):
            out[item, rank, doc, -s] += 1
    return out


@pytest.mark.parametrize("size,fan,block", [(1024, 16, 200_000), (7, 2, 150), (64, 3, 400)])
def test_search(spark, odd, empty, monkeypatch, size, fan, block):
    monkeypatch.setattr(ranked, "RANGE", size)
    monkeypatch.setattr(ranked, "FAN", fan)
    rng = random.Random(9)
    pool = [words(rng, 1) for _ in range(60)]
    docs = [(r[0], r[1]) for r in odd_rows()] + [(1000 + i, words(rng, rng.randint(1, 60), pool)) for i in range(300)] + [(2000 + i % 40, "ties are by id") for i in range(60)] + [(None, "ties are by id")]
    items = [(i, words(rng, rng.randint(1, 30), pool)) for i in range(12)] + [(20, None), (21, ""), (22, "absent words42"), (23, "TIES, by id!"), (23, "TIES, by id!"), (24, "größe"), (25, "one"), (25, "two words"), (None, "ties")]
    items += [(30, next(t for _, t in docs if t and len(t) > 20000))]
    table = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, terms int").repartition(5)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    got = Counter(tuple(r) for r in ranked.search(table, asked, block_terms=block).collect())
    assert got == found(docs, items, 10)
    assert ranked.search(empty, asked).count() == 0 and ranked.search(odd, asked.limit(0)).count() == 0


def test_search_opens_no_more_than_it_must():
    """With one document far ahead, few nodes are opened, and scores stay whole."""
    rng = np.random.default_rng(1)
    terms = np.sort(rng.integers(0, 50, (1024, 8)), axis=1).ravel()
    parts = rng.integers(1, 1000, len(terms))
    parts[8 * 77 : 8 * 78] = 10**6
    tree, best = ranked.Tree(np.arange(0, len(terms) + 1, 8), terms, parts), []
    want = sorted(((int(sum(p for t, p in zip(terms[8 * d : 8 * d + 8], parts[8 * d : 8 * d + 8]) if t in (3, 4, 5))), -d) for d in range(1024)), reverse=True)[:3]
    tree.search(np.array([3, 4, 5]), np.array([1, 1, 1]), best, 3, list(range(1024)))
    assert sorted(((s, -d) for s, _, _, d in best), reverse=True) == [w for w in want if w[0] > 0]


# ---- similarity join ----


def test_a_list_whose_members_cannot_be_alike_is_not_paired(spark):
    """Texts that share 80 of 97 shingles: alike by none of their classes, so no pair of members is made; with a few near copies among them."""
    from tallybrook.llm import jaccard

    common = " ".join(f"c{i}" for i in range(84))
    texts = [f"{common} " + " ".join(f"u{d}x{i}" for i in range(17)) for d in range(300)]
    texts += [texts[5] + " more", texts[6] + " words here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    assert got == {i: {300: 5, 301: 6}.get(i, i) for i in range(302)}
    sets = spark.createDataFrame([(1, 97, 17, 20, d, -1) for d in range(300)], "l long, n long, own long, at long, c long, most long").withColumn("k", jaccard.banded())
    assert jaccard.alike_classes(sets, 75).count() == 0 and sets.select("k").distinct().count() == 1
