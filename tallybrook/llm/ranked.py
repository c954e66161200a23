"""Ranked lexical search by a hierarchical max tree.

Documents are read once: a document keeps its number of terms and its counts of terms that some item may have. Tasks cut what they hold
into ranges of up to RANGE documents. For each term a range has a tree: the greatest contribution of the term to a document's score in
the range, in each of its FAN-th parts, and so on down to leaves of FAN documents. An item's bound for a node is the sum of its terms'
weights times these maxima, so no document of the node scores higher. Search is best first: the node with the highest bound is opened,
leaves are scored exactly, and the search ends where the bound falls below the worst of the best ``k`` found by the task so far; nodes
whose bound equals it are still opened, since of equal scores the smaller id counts. Scores are whole numbers, so bounds are exact.

Items come in blocks of bounded size; each block is sent to all tasks, which pass over the stored counts. Per item and task no more than
``k`` documents leave a task.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybrook.llm.common import FILTER_BITS, batch_of, filter_words, released, rows_of, staged

#: Terms: everything but ASCII characters that are neither letters nor digits; the same over UTF-8 bytes of lower-cased text.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = rb"[0-9a-z\x80-\xff]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Children of a node; documents of a range, and entries after which it is closed earlier.
FAN, RANGE, RANGE_TERMS = 16, 1024, 1 << 20
#: Pairs of item and term in a block of items.
BLOCK_TERMS = 200_000
#: Words a task remembers to be or not to be in the filter.
KNOWN = 200_000


def term_counts(docs: DataFrame, words: np.ndarray, key: str, text: str) -> DataFrame:
    """doc_id, n, terms, tfs of documents with a term; terms that the filter ``words`` leaves out aren't listed, but counted in n."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, bits, known = re.compile(TERM_BYTES).findall, held.value, {}

        def among(w: bytes) -> bool:
            told = known.get(w)
            if told is None:
                if len(known) >= KNOWN:
                    known.clear()
                b = xxhash.xxh64_intdigest(w, 42) % FILTER_BITS
                told = known[w] = bool(int(bits[b >> 5]) >> (b & 31) & 1)
            return told

        for batch in batches:
            schema = pa.schema([pa.field("doc_id", batch.schema.field(0).type), pa.field("n", pa.int64()), pa.field("terms", pa.list_(pa.string())), pa.field("tfs", pa.list_(pa.int64()))])
            out, size = [], 0
            for k, t in rows_of(batch):
                found = find((t or "").encode().lower())
                if found:
                    some = {w.decode(): c for w, c in Counter(found).items() if among(w)}
                    out.append((k, len(found), list(some), list(some.values())))
                    size += len(some)
                if size > 200_000:
                    yield batch_of(out, schema)
                    out, size = [], 0
            if out:
                yield batch_of(out, schema)

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(released(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, terms array<string>, tfs array<long>")


class Tree:
    """The max tree of a range: ``terms`` (sorted numbers of terms), for each level a matrix of maxima by term and node."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, parts: np.ndarray) -> None:
        """``starts``: where each document's entries begin, and the end of the last; ``terms`` and ``parts``: an entry's term and contribution."""
        self.starts, self.parts = starts, parts
        self.terms, self.at = np.unique(terms, return_inverse=True)
        docs = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        leaves = -(-(len(starts) - 1) // FAN)
        where = self.at * leaves + docs // FAN
        order = np.argsort(where, kind="stable")
        where = where[order]
        first = np.flatnonzero(np.diff(where, prepend=-1))
        low = np.zeros(len(self.terms) * leaves, np.int64)
        if len(first):
            low[where[first]] = np.maximum.reduceat(parts[order], first)
        self.levels = [low.reshape(len(self.terms), leaves)]
        while self.levels[0].shape[1] > 1:
            below = self.levels[0]
            pad = -below.shape[1] % FAN
            self.levels.insert(0, np.pad(below, ((0, 0), (0, pad))).reshape(len(below), (below.shape[1] + pad) // FAN, FAN).max(2, initial=0))

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list, k: int, ids: list) -> None:
        """Adds documents to ``best``, a heap of (score, -id, id) of ``k`` at most; ids that are null come last."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        here = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        at, weights = at[here], weights[here]
        if not len(at):
            return
        full = np.zeros(len(self.terms), np.int64)
        full[at] = weights
        n = len(self.starts) - 1
        queue = [(-int(weights @ self.levels[0][at, 0]), 0, 0)]
        while queue:
            bound, level, node = heapq.heappop(queue)
            if bound == 0 or (len(best) == k and -bound < best[0][0]):
                return
            if level + 1 < len(self.levels):
                a, b = node * FAN, min(node * FAN + FAN, self.levels[level + 1].shape[1])
                for i, s in enumerate((weights @ self.levels[level + 1][at, a:b]).tolist()):
                    if s and (len(best) < k or s >= best[0][0]):
                        heapq.heappush(queue, (-s, level + 1, a + i))
                continue
            a, b = node * FAN, min(node * FAN + FAN, n)
            lo, hi = self.starts[a], self.starts[b]
            sums = np.concatenate([[0], np.cumsum(self.parts[lo:hi] * full[self.at[lo:hi]])])
            for i, s in enumerate((sums[self.starts[a + 1 : b + 1] - lo] - sums[self.starts[a:b] - lo]).tolist()):
                if s > 0 and (len(best) < k or s >= best[0][0]):
                    doc = ids[a + i]
                    entry = (s, -doc if doc is not None else float("-inf"), a + i, doc)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry[:2] > best[0][:2]:
                        heapq.heapreplace(best, entry)


def searched(counts: DataFrame, items: list[tuple], item_type: str, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item_id, doc_id, score: for each of ``items`` (id, terms, weights) the best ``k`` documents of each task."""
    names = {t: i for i, t in enumerate(sorted({t for _, terms, _ in items for t in terms}))}
    packed = [(i, np.array([names[t] for t in terms], np.int64), np.array(w, np.int64)) for i, terms, w in items]
    held = counts.sparkSession.sparkContext.broadcast((names, packed))  # a block of items
    doc_type = counts.schema["doc_id"].dataType.simpleString()
    schema = T._parse_datatype_string(f"item_id {item_type}, doc_id {doc_type}, score long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names, packed = held.value
        best: list[list] = [[] for _ in packed]
        ids, sizes, terms, parts, entries = [], [], [], [], 0

        def close() -> None:
            nonlocal ids, sizes, terms, parts, entries
            if entries:
                tree = Tree(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(terms), np.concatenate(parts))
                for heap, (_, t, w) in zip(best, packed, strict=True):
                    tree.search(t, w, heap, k, ids)
            ids, sizes, terms, parts, entries = [], [], [], [], 0

        for batch in batches:
            for start in range(0, batch.num_rows, RANGE // 4):
                piece = batch.slice(start, RANGE // 4)
                words = piece.column(2).flatten().dictionary_encode()
                number = np.array([names.get(w, -1) for w in words.dictionary.to_pylist()], np.int64)
                term = number[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
                tf = piece.column(3).flatten().to_numpy(zero_copy_only=False)
                lengths = piece.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                m = 25 + 75 * piece.column(1).to_numpy(zero_copy_only=False) * n_docs // n_terms
                part = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, lengths))
                own = np.repeat(np.arange(len(lengths)), lengths)[term >= 0]
                ids += piece.column(0).to_pylist()
                sizes.append(np.bincount(own, minlength=len(lengths)))
                terms.append(term[term >= 0])
                parts.append(part[term >= 0])
                entries += len(own)
                if len(ids) >= RANGE or entries >= RANGE_TERMS:
                    close()
        close()
        rows = [(i, doc, score) for (i, _, _), heap in zip(packed, best, strict=True) for score, _, _, doc in heap]
        for a in range(0, len(rows), 10_000):
            yield batch_of(rows[a : a + 10_000], to_arrow_schema(schema))

    return counts.mapInArrow(released(run), schema)


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: for each item the ``k`` documents with the highest scores above 0, equal scores by ascending id.

    With N documents that have terms, L terms in all, n terms of a document, df documents with a term and tf occurrences in the document, a
    term weighs floor(1000 ln((2 N + 2) / (2 df + 1))) and adds (10^9 tf) div (1000 tf + 8 m), m = 25 + (75 n N) div L, each time the item has it. Null and empty texts have no terms: as documents they don't count, as items they find nothing. Documents with equal ids
    are ranked each; a null id comes last among equal scores. Items with equal id and text are one; different texts of an id are put together.
    Without documents or items there are no rows. Other columns are ignored, whatever their names.
    """
    asked = items.select(F.col(item).alias("item_id"), F.col(text).alias("text")).distinct()
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    asked = staged(asked.select("item_id", F.explode(words).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")), "item-terms")
    counts = staged(term_counts(docs, filter_words(asked.select("term"), "term"), key, text), "term-counts")
    n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.log(F.lit(2.0 * n_docs + 2) / (F.col("df") * 2 + 1)) * 1000).cast("long")
    weighed = asked.join(frequency, "term").withColumn("w", weight * F.col("times")).filter("w > 0")
    weighed = staged(weighed.groupBy("item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("weights")), "item-weights")
    blocks = max(1, -(-(weighed.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms))
    found, item_type = None, weighed.schema["item_id"].dataType.simpleString()
    for b in range(blocks):  # a block's size doesn't grow with items or documents
        rows = [tuple(r) for r in weighed.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]
        some = searched(counts, rows, item_type, n_docs, max(n_terms, 1), k)
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
