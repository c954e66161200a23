"""Byte-level BPE by reduction of a tree of halves.

A text's encoding is a monoid: an element is a stretch of text with the words that the splitting pattern finds in it alone, and each word's
tokens. A text is encoded by halves, down to LEAF characters, and neighbours are joined up the tree:

* Words. The pattern looks at no character before a word and at no more than one behind its end, so all words of the left part that
  end two characters or more before its end stay. From there on the joined text is split again, with a window that doubles into the right
  part, until a boundary coincides with one the right part has: from a boundary on, splitting depends on what follows only.
* Tokens of a word that spans the seam. Its two token lists are joined by encoding the bytes of the last k tokens of the left and
  the first k of the right again, k doubling, until the tokens at both rims of the window are at peace with their neighbours outside,
  that is, the two tokens' bytes alone encode to these two tokens. A list whose neighbours are all at peace is the encoding of its
  bytes: the first merge across a boundary would be the first merge across it in the two tokens' bytes as well. So nothing outside the
  window can change. Long words are encoded by halves in the same way.

Short words that a block of texts is the first to hold are merged side by side, those of one size as the rows of a matrix.

Decoding concatenates the tokens' bytes up a tree of halves. A task holds the vocabulary, a bounded store of words, and a block of texts, or
one longer text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import accumulate, chain, pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.common import batch_of, released, rows_of

#: Characters of a leaf; bytes up to which a word is merged without halving; words and pairs of tokens a task remembers.
LEAF, SHORT, KNOWN = 4096, 32, 200_000
#: Rank of a pair that isn't a token.
NONE = 1 << 40
#: Bytes of results that go out together; characters of texts that are encoded together.
OUT_BYTES, BLOCK_CHARS = 4 << 20, 1 << 20


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and a rank on each line."""
    import public_tokenizers

    lines = Path(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, lines))}


def stretches(start: int, end: int) -> Iterator[tuple[int, int]]:
    """The leaves of a text's tree of halves."""
    if end - start <= LEAF:
        yield start, end
    else:
        mid = (start + end) // 2
        yield from stretches(start, mid)
        yield from stretches(mid, end)


class Pairs:
    """The ranks of pairs of tokens that are a token together."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        found = [(a << 32 | b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        keys, rank = np.array([*found, (-1, NONE)], np.int64).T
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], rank[order]

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where a pair is no token."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key, side="right") - 1
        return np.where(self.keys[at] == key, self.rank[at], NONE)


class Coder:
    """Encodes and decodes texts by the ranks of tokens; ``pattern`` splits texts into words that are encoded separately.

    The pattern must look at no character before a word and at no more than one behind it, and its words must cover all text.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.token = {i: t for t, i in ranks.items()}
        self.pairs, self.bytes = Pairs(ranks), np.array([ranks.get(bytes([b]), -1) for b in range(256)])
        self.words: dict[str, tuple[int, ...]] = {}
        self.peace: dict[tuple[int, int], bool] = {}

    # ---- bytes ----

    def merge(self, raw: bytes) -> list[int]:
        """Merges the pair of least rank, the first of equal ones, until none is left."""
        ranks, n = self.ranks, len(raw)
        if n <= 4 * SHORT:
            get, cuts = ranks.get, list(range(n + 1))
            pairs = [get(raw[i : i + 2], NONE) for i in range(n - 1)]
            while pairs and (least := min(pairs)) != NONE:
                i = pairs.index(least)
                del cuts[i + 1], pairs[i]
                if i < len(pairs):
                    pairs[i] = get(raw[cuts[i] : cuts[i + 2]], NONE)
                if i:
                    pairs[i - 1] = get(raw[cuts[i - 1] : cuts[i + 1]], NONE)
            return [ranks[raw[a:b]] for a, b in pairwise(cuts)]
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i; 0: no part any more
        queue = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, mid, stop = heapq.heappop(queue)
            if end[i] != mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(raw[i : end[stop]])) is not None:
                    heapq.heappush(queue, (r, i, stop, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(raw[p:stop])) is not None:
                heapq.heappush(queue, (r, p, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def at_peace(self, a: int, b: int) -> bool:
        known = self.peace.get((a, b))
        if known is None:
            if len(self.peace) >= KNOWN:
                self.peace.clear()
            known = self.peace[a, b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return known

    def join_tokens(self, left: Sequence[int], right: Sequence[int]) -> list[int]:
        """The encoding of the bytes of two encodings together."""
        left, right, k = list(left), list(right), 1
        if not left or not right:
            return left + right
        while True:
            i, j = max(0, len(left) - k), min(k, len(right))
            window = self.merge(b"".join(map(self.token.__getitem__, left[i:] + right[:j])))
            if (i == 0 or self.at_peace(left[i - 1], window[0])) and (j == len(right) or self.at_peace(window[-1], right[j])):
                return left[:i] + window + right[j:]
            k *= 2

    def halves(self, raw: bytes) -> list[int]:
        if len(raw) <= SHORT:
            return self.merge(raw)
        mid = len(raw) // 2
        return self.join_tokens(self.halves(raw[:mid]), self.halves(raw[mid:]))

    def word(self, text: str) -> tuple[int, ...]:
        known = self.words.get(text)
        if known is None:
            raw = text.encode()
            known = (self.ranks[raw],) if raw in self.ranks else tuple(self.halves(raw))
            if len(raw) <= 2 * SHORT:
                if len(self.words) >= KNOWN:
                    self.words.clear()
                self.words[text] = known
        return known

    def merged(self, raws: list[bytes]) -> list[list[int]]:
        """What ``merge`` gives for each of some strings of one size: each step merges one pair of every row that still has one."""
        tokens, out = self.bytes[np.frombuffer(b"".join(raws), np.uint8)].reshape(len(raws), -1), [[]] * len(raws)
        pairs, who = self.pairs.of(tokens[:, :-1], tokens[:, 1:]), np.arange(len(raws))
        while len(who):
            row, at, least = np.arange(len(who)), np.zeros(len(who), np.int64), np.full(len(who), NONE)
            if pairs.shape[1]:
                at = pairs.argmin(1)
                least = pairs[row, at]
            done = least == NONE
            if done.any():
                for i, ids in zip(who[done].tolist(), tokens[done].tolist(), strict=True):
                    out[i] = ids
                who, tokens, pairs, at, least = who[~done], tokens[~done], pairs[~done], at[~done], least[~done]
                row = row[: len(who)]
            if len(who):
                tokens[row, at] = least
                kept, others = np.ones(tokens.shape, bool), np.ones(pairs.shape, bool)
                kept[row, at + 1] = others[row, at] = False
                tokens, pairs = tokens[kept].reshape(len(who), -1), pairs[others].reshape(len(who), -1)
                for rows, i in ((row[at > 0], at[at > 0] - 1), (row[at < pairs.shape[1]], at[at < pairs.shape[1]])):
                    pairs[rows, i] = self.pairs.of(tokens[rows, i], tokens[rows, i + 1])
        return out

    def learn(self, leaves: Iterable[list[str]]) -> None:
        """Remembers the tokens of short words that aren't known yet."""
        words = set(chain.from_iterable(leaves))
        fresh, whole = [w for w in words if w not in self.words], self.bytes.min() >= 0
        if len(self.words) + len(fresh) > KNOWN:
            self.words.clear()
            fresh = list(words)
        same: dict[int, list[tuple[str, bytes]]] = {}
        for w in fresh:
            raw = w.encode()
            if (r := self.ranks.get(raw)) is not None:
                self.words[w] = (r,)
            elif len(raw) <= SHORT and whole:
                same.setdefault(len(raw), []).append((w, raw))
        for group in same.values():
            for (w, _), ids in zip(group, self.merged([raw for _, raw in group]), strict=True):
                self.words[w] = tuple(ids)

    # ---- texts: an element is (start, end, ends of words, tokens of words) ----

    def leaf(self, text: str, start: int, end: int, cut: dict[int, list[str]]) -> tuple:
        """``cut`` has the words of leaves that were split and learnt before, by start."""
        words, get = cut.pop(start, None), self.words.get
        if words is None:
            words = self.split(text[start:end])
            self.learn([words])
        return start, end, list(accumulate(map(len, words), initial=start))[1:], [get(w) or self.word(w) for w in words]

    def join(self, text: str, left: tuple, right: tuple) -> tuple:
        """The element of two neighbours' text."""
        (start, seam, ends, tokens), (_, end, ends2, tokens2) = left, right
        if not ends or not ends2:
            return start, end, ends + ends2, tokens + tokens2
        keep = len(ends)
        while keep and ends[keep - 1] > seam - 2:
            keep -= 1
        at, k = ends[keep - 1] if keep else start, 1
        while True:
            k = min(k, len(ends2))
            stop, bounds = ends2[k - 1], {seam: 0} | {e: n + 1 for n, e in enumerate(ends2[:k])}
            sure = stop if k == len(ends2) else stop - 2
            cuts = list(accumulate(map(len, self.split(text[at:stop])), initial=at))
            found = next((c for c in range(1, len(cuts)) if cuts[c] <= sure and cuts[c] in bounds), None)
            if found is not None:
                break
            k *= 2
        new, taken = cuts[1 : found + 1], bounds[cuts[found]]
        fresh = [self.spanning(text, a, b, (start, *ends), tokens, seam, ends2, tokens2) for a, b in zip(cuts, new, strict=False)]
        return start, end, ends[:keep] + new + ends2[taken:], tokens[:keep] + fresh + tokens2[taken:]

    def spanning(self, text: str, a: int, b: int, starts: Sequence[int], tokens: list, seam: int, ends2: list, tokens2: list) -> tuple[int, ...]:
        """Tokens of the word from a to b; one that spans the seam is joined from the tokens both sides have."""
        if b - a > SHORT and a < seam < b:
            i = next((i for i in range(len(starts) - 1, -1, -1) if starts[i] <= a), 0)
            j = next((j for j, e in enumerate(ends2) if e >= b), len(ends2) - 1)
            raw = text[a:b].encode()
            if starts[i] == a and ends2[j] == b and raw not in self.ranks:
                return tuple(reduce(self.join_tokens, [*tokens[i:], *tokens2[: j + 1]]))
        return self.word(text[a:b])

    def element(self, text: str, start: int, end: int, cut: dict[int, list[str]]) -> tuple:
        if end - start <= LEAF:
            return self.leaf(text, start, end, cut)
        mid = (start + end) // 2
        return self.join(text, self.element(text, start, mid, cut), self.element(text, mid, end, cut))

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. New words of all are merged together, those of a text above BLOCK_CHARS leaf by leaf."""
        cuts = [{a: self.split(t[a:b]) for a, b in stretches(0, len(t))} if len(t) <= BLOCK_CHARS else {} for t in texts]
        self.learn(chain.from_iterable(x.values() for x in cuts))
        return [list(chain.from_iterable(self.element(t, 0, len(t), x)[3])) for t, x in zip(texts, cuts, strict=True)]

    def decode(self, ids: Sequence[int]) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self.token.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (binary: little-endian unsigned 32-bit integers) and ``decoded`` (binary: the bytes of these ids), one row per row of ``docs``.

    A null or empty text has no tokens; special tokens' strings are ordinary text. Repeated rows come repeatedly, null keys as null;
    there are no ties. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast((ranks, pattern))  # a vocabulary: some 50,000 tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, schema = Coder(*held.value), None
        for batch in batches:
            schema = schema or pa.schema([pa.field("key", batch.schema.field(0).type), pa.field("ids", pa.binary()), pa.field("decoded", pa.binary())])
            out, size, keys, texts, chars = [], 0, [], [], 0
            for i, (k, t) in enumerate(rows_of(batch)):
                keys.append(k)
                texts.append(t or "")
                chars += len(texts[-1])
                if chars < BLOCK_CHARS and i < batch.num_rows - 1:
                    continue
                for key_, ids in zip(keys, coder.encode_all(texts), strict=True):
                    out.append((key_, np.fromiter(ids, "<u4", len(ids)).tobytes(), coder.decode(ids)))
                    size += len(out[-1][1]) + len(out[-1][2])
                    if size > OUT_BYTES:
                        yield batch_of(out, schema)
                        out, size = [], 0
                keys, texts, chars = [], [], 0
            if out:
                yield batch_of(out, schema)

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"key {kind}, ids binary, decoded binary").withColumnRenamed("key", key)
