"""Hidden Markov language model over words, trained by Baum-Welch with counts summed across partitions.

A state emits a word class, and the class emits the word: P(word | state) = P(class | state) P(word | class). The most frequent
words are classes of their own, all others share classes by their last bytes, so the tables that iterate are of fixed size
(states x classes) however large the vocabulary is; word counts are joined through a shuffle. The scaled forward recursion gives
a text's exact likelihood; class-to-word factors don't depend on the state, so they are one sum per text.

Texts become sequences of word numbers of their block (one Arrow batch), the block's dictionary is joined with corpus counts, and
block and dictionary meet again in one group, whose size the batch bounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.common import staged, unstage

#: Latent states; words with a class of their own; classes of the others by suffix; class 0 is the end of a text.
STATES, FREQUENT, SUFFIXES = 8, 1023, 1024
CLASSES = 1 + FREQUENT + SUFFIXES
#: Rounds of training, each over all training texts, at every size of the input.
ROUNDS = 8
#: Added to expected counts: starts and transitions, emissions.
PSEUDO, PSEUDO_EMIT = 0.1, 0.02
#: Tokens of a block's dictionary at most, and of texts whose recursions run side by side.
BLOCK_TOKENS, SIDE_TOKENS = 3_000_000, 600_000
END = b"\n"  # no word holds it


def words(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per text its word numbers, and per block one row with the words' hashes, training counts and suffix classes."""
    from pyspark import TaskContext

    context, count = TaskContext.get(), 0
    for b in batches:
        texts, at = b["t"].tolist(), 0
        while at < len(texts):
            numbers, rows, total = Numbers(), [], 0
            block, count = f"{context.partitionId()}-{count}", count + 1
            while at < len(texts) and total < BLOCK_TOKENS:
                ids = np.fromiter(map(numbers.__getitem__, words(texts[at])), np.int32)
                rows.append((block, b["key"].iat[at], b["held"].iat[at], ids))
                total, at = total + len(ids), at + 1
            train = [r[3] for r in rows if not r[2]]
            counts = np.bincount(np.concatenate(train), minlength=len(numbers)) if train else np.zeros(len(numbers), np.int64)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers)).view(np.int64)
            suffix = np.fromiter((zlib.crc32(w[-3:]) % SUFFIXES for w in numbers), np.int32, len(numbers))
            suffix[numbers[END]] = -1
            out = pd.DataFrame([(*r[:3], r[3].tobytes()) for r in rows], columns=["block", "key", "held", "ids"])
            yield out.assign(hashes=None, counts=None, suffix=None).astype({"key": "Int64"})
            yield pd.DataFrame({"block": [block], "key": pd.array([None], "Int64"), "held": [None], "ids": [None], "hashes": [hashes], "counts": [counts], "suffix": [suffix]})


_ENCODED = "block string, key long, held boolean, ids binary, hashes array<long>, counts array<long>, suffix array<int>"
_SEQUENCES = "key long, held boolean, n_tokens long, n_known long, base_score double, word_score double, classes binary"


def _side_by_side(seqs: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Sequences in groups of like length, longest first within a group."""
    seqs, group, longest = sorted(seqs, key=len, reverse=True), [], 0
    for s in seqs:
        longest = longest or len(s)
        if group and longest * (len(group) + 1) > SIDE_TOKENS:
            yield group
            group, longest = [], len(s)
        group.append(s)
    if group:
        yield group


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit  # emit: classes x states

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Hmm:
        k = STATES
        start, move, emit = counts[:k] + PSEUDO, counts[k : k + k * k].reshape(k, k) + PSEUDO, counts[k + k * k :].reshape(CLASSES, k) + PSEUDO_EMIT
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    @classmethod
    def seeded(cls, seqs: list[np.ndarray], seed: int) -> Hmm:
        return cls.from_seen(np.bincount(np.concatenate(seqs), minlength=CLASSES) if seqs else np.zeros(CLASSES), seed)

    @classmethod
    def from_seen(cls, seen: np.ndarray, seed: int) -> Hmm:
        """The model that training starts from: states differ by seeded noise around the counts of classes."""
        rng = np.random.default_rng(seed)
        emit = (seen[:, None] + 0.5) * np.exp(rng.normal(0, 0.7, (CLASSES, STATES)))
        move = np.eye(STATES) * STATES + 1 + rng.random((STATES, STATES))
        return cls(np.full(STATES, 1 / STATES), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def forward(self, group: list[np.ndarray], keep: bool = False) -> tuple:
        """Natural log-likelihoods of sequences sorted by falling length; with ``keep`` the scaled forward variables and predictions.

        Step t has the sequences longer than t side by side, and steps follow each other: ``bounds[t]`` is where it starts.
        """
        lengths = np.array([len(s) for s in group])
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        bounds = np.concatenate([[0], np.cumsum(alive)]).tolist()
        grid, at = np.empty(bounds[-1], np.intp), np.array(bounds)
        for i, s in enumerate(group):
            grid[at[: len(s)] + i] = s
        kind = np.float32 if keep else np.float64  # expected counts need no more
        emit, move = (np.ascontiguousarray(x.T, dtype=kind) for x in (self.emit, self.move))
        alphas, ahead = (np.empty((STATES, len(grid)), kind), np.empty((STATES, len(grid)), kind)) if keep else (None, None)
        total = np.zeros(len(group))
        a = None
        for t, (low, high) in enumerate(zip(bounds, bounds[1:])):
            m = high - low
            p = np.repeat(self.start[:, None].astype(kind), m, axis=1) if t == 0 else move @ a[:, :m]
            a = emit.take(grid[low:high], axis=1)
            a *= p
            s = a.sum(axis=0)
            a *= 1 / s
            if keep:
                ahead[:, low:high], alphas[:, low:high] = p, a
            else:
                total[:m] += np.log(s)
        return total, grid, bounds, alphas, ahead

    def expected(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Expected counts of starts, transitions and emissions in one vector."""
        k = STATES
        start, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k))
        for group in _side_by_side(seqs):
            _, grid, bounds, alphas, ahead = self.forward(group, keep=True)
            move = self.move.astype(alphas.dtype)
            for low, high, end in list(zip(bounds, bounds[1:], bounds[2:]))[::-1]:
                now = alphas[:, low : low + end - high]
                down = alphas[:, high:end] / ahead[:, high:end]  # posterior by prediction
                moves += now @ down.T
                now *= move @ down  # now the posterior; that of a text's last step is as it was
            start += alphas[:, : bounds[1]].sum(axis=1)
            for j in range(k):
                emits[:, j] += np.bincount(grid, weights=alphas[j], minlength=CLASSES)
        return np.concatenate([start, (moves * self.move).ravel(), emits.ravel()])


def _classes(raw: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int16) for x in raw]


def score(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    ``held``: a Boolean column, true for rows to leave out of training. Words are runs without ASCII white space after lower-casing
    A-Z, then an end token. ``base_score`` is the add-half unigram log10 probability, ``score`` the model's. Null and empty texts
    have the end token alone; equal rows are scored each and count each; without training rows all word probabilities are those
    of unknown words and the states stay as seeded. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), held.alias("held"), F.col(text).alias("t"))
    encoded = staged(rows.mapInPandas(_blocks, _ENCODED), "encoded")
    zipped = encoded.filter("hashes is not null").select("block", F.posexplode(F.arrays_zip("hashes", "counts", "suffix")).alias("id", "w"))
    dictionary = zipped.select("block", "id", F.col("w.hashes").alias("h"), F.col("w.counts").alias("n"), F.col("w.suffix").alias("s"))
    vocabulary = staged(dictionary.groupBy("h").agg(F.sum("n").alias("c"), F.min("s").alias("s")), "vocabulary")
    top = vocabulary.filter("s >= 0 and c > 0").orderBy(F.col("c").desc(), "h").limit(FREQUENT).select("h", "c").collect()
    end = vocabulary.filter("s < 0").select("h", "c").collect()  # one row
    # words of most blocks are told by broadcast, FREQUENT + 1 rows at most, so that no key of the join has a row of every block
    often = F.broadcast(spark.createDataFrame([*((r.h, r.c, 0) for r in end), *((r.h, r.c, i + 1) for i, r in enumerate(top))], "h long, c long, g int"))
    other = F.expr(f"s + {1 + FREQUENT}")
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    classed = vocabulary.filter("c > 0").join(often.select("h", "g"), "h", "left").groupBy(F.coalesce("g", other).alias("g"))
    for r in classed.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # CLASSES rows at most
        n_class[r.g], v_class[r.g] = r.n, r.v
    told = dictionary.join(often, "h", "left")
    rest = told.filter("g is null").select("h", "block", "id", other.alias("g")).join(vocabulary.select("h", "c"), "h")
    counted_in = told.filter("g is not null").select("block", "id", "c", "g").unionByName(rest.select("block", "id", "c", "g"))
    n_all, v_all = n_class.sum(), v_class.sum()
    scale = np.log10(n_class + 0.5 * (v_class + 1))

    def sequences(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        size = int(known["id"].max()) + 1 if len(known) else 0
        c, g = np.zeros(size), np.zeros(size, np.int16)
        c[known["id"]], g[known["id"]] = known["c"], known["g"]
        log = np.log10(c + 0.5)
        word = log - scale[g]
        base = log - np.log10(n_all + 0.5 * (v_all + 1))
        out = []
        for k, held_out, raw in zip(texts["key"], texts["held"], texts["ids"], strict=True):
            ids = np.frombuffer(raw, np.int32)
            out.append((k, held_out, len(ids), int((c[ids] > 0).sum()), base[ids].sum(), word[ids].sum(), g[ids].tobytes()))
        return pd.DataFrame(out, columns=["key", "held", "n_tokens", "n_known", "base_score", "word_score", "classes"]).astype({"key": "Int64"})

    joined = encoded.filter("ids is not null").select("block", "key", "held", "ids").groupBy("block").cogroup(counted_in.withColumnRenamed("block", "of").groupBy("of"))
    seqs = staged(joined.applyInPandas(sequences, _SEQUENCES), "sequences")
    unstage(encoded)
    unstage(vocabulary)
    train = seqs.filter("not held").select("key", "classes")
    model = Hmm.from_seen(n_class, seed)
    for _ in range(ROUNDS if n_all else 0):
        now = spark.sparkContext.broadcast(model)

        def counted(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            total = np.zeros(STATES + STATES * STATES + CLASSES * STATES)
            for b in batches:
                total += now.value.expected(_classes(b["classes"]))
            at = np.flatnonzero(total)
            yield pd.DataFrame({"i": at, "x": total[at]})

        counts = np.zeros(STATES + STATES * STATES + CLASSES * STATES)
        got = train.select("classes").mapInPandas(counted, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()  # as long as ``counts`` at most
        counts[got["i"]] = got["x"]
        model = Hmm.from_counts(counts)
    final = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def likelihood(raw: pd.Series) -> pd.Series:
        seqs, out = _classes(raw), np.zeros(len(raw))
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        at = 0
        for group in _side_by_side(seqs):
            out[order[at : at + len(group)]] = final.value.forward(group)[0]
            at += len(group)
        return pd.Series(out / np.log(10))

    return seqs.select(
        F.col("key").alias("doc_id"),
        F.col("held").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        "base_score",
        (F.col("word_score") + likelihood("classes")).alias("score"),
    )
