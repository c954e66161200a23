"""SentencePiece encoding and decoding: sampling of distinct segmentations by Gumbel top-k over the piece lattice.

Pieces are weighted by rank (Zipf's law with exponent ``theta``), which makes each segmentation's probability the product of its
pieces' weights over the sum for all segmentations. The ``k`` segmentations with the largest perturbed log-probabilities
(Gumbel noise) are a sample without replacement. They come from a best-first search: a queue holds the exact greatest perturbed
value below each partial path; the best is walked to the end, drawing the values of the branches it passes conditionally on its
own. Once a path's prefix has become CUT nats less likely, all branches farther on are queued as one set with its own greatest
value; a set that comes to the head of the queue is split into its branches, given that value, so none is ever dropped.
Walks, draws and queues are done for all texts of a block at once.

No piece but a run of spaces holds a space after its first character, so a text's lattice is a chain of small ones. Each distinct
one is built once and kept for later blocks, until the kept ones have EDGES edges. All noise is a function of seed, row key,
sample number and place.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybrook.llm.common import key_text, released

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of texts times samples that are worked on together; edges of lattices that a task keeps before it starts anew.
BLOCK_CHARS, EDGES = 200_000, 250_000
#: Nats after which branches are queued as one set; rank shift of Zipf's law.
CUT, SHIFT = 20.0, 2.7
PART = re.compile(rf"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
M64 = (1 << 64) - 1


#: Slots of the trie's hash table.
TABLE = 1 << 19


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)


class Numbers(dict):
    """Numbers of parts by first appearance."""

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        return n


@dataclass
class Vocabulary:
    """A trie of the pieces (hash table of state and character to next state, each state's piece or -1), weights, byte pieces, bytes."""

    keys: np.ndarray
    to: np.ndarray
    piece: np.ndarray
    weight: np.ndarray
    byte_ids: list[int]
    byte_weight: float
    raw: list[bytes]

    @classmethod
    def load(cls, path: str = MODEL, theta: float = 1.0) -> Vocabulary:
        """Reads a SentencePiece model with byte fallback. Only the driver needs the file."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        norm = math.log(math.log((n + SHIFT) / SHIFT))
        weigh = lambda rank: theta * (-math.log(rank + SHIFT) - norm)
        states, piece, weight, raw, byte_ids = {}, [-1], np.zeros(n), [b""] * n, [0] * 256
        for i in range(n):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(text[3:5], 16)] = i
                raw[i] = bytes([int(text[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                if not PART.fullmatch(text):
                    raise ValueError(f"piece {i} spans words, so texts can't be cut at spaces and newlines")
                weight[i], raw[i], at = weigh(min(-model.get_score(i), n)), text.replace(SPACE, " ").encode(), 0
                for c in text:
                    key = at << 21 | ord(c)
                    if key not in states:
                        states[key] = len(piece)
                        piece.append(-1)
                    at = states[key]
                piece[at] = i
        keys, to = np.full(TABLE, -1, np.int64), np.zeros(TABLE, np.int32)
        for key, state in states.items():
            at = int(_slot(np.array([key]))[0])
            while keys[at] >= 0:
                at = (at + 1) % TABLE
            keys[at], to[at] = key, state
        return cls(keys, to, np.array(piece, np.int32), weight, byte_ids, weigh(n), raw)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is none."""
        key = state.astype(np.int64) << 21 | char
        at = _slot(key)
        seen = self.keys[at]
        out = np.where(seen == key, self.to[at], -1)
        open_ = np.flatnonzero((seen != key) & (seen >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % TABLE
            seen = self.keys[at[open_]]
            hit = seen == key[open_]
            out[open_[hit]] = self.to[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out

    def __post_init__(self) -> None:
        self.sizes = np.fromiter(map(len, self.raw), np.int32, len(self.raw))
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.joined = np.frombuffer(b"".join(self.raw), np.uint8)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode(errors="replace")


class Lattices:
    """The lattices of distinct parts, as flat arrays over nodes (characters, and an end for each part) and edges sorted by node."""

    def __init__(self, v: Vocabulary, parts: list[str]) -> None:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.first = np.cumsum(np.concatenate([[0], lengths + 1]))[:-1]
        self.last = self.first + lengths
        chars = np.frombuffer("\ud800".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        nodes = len(chars)
        owner = np.repeat(np.arange(len(parts)), lengths + 1)
        left = self.last[owner] - np.arange(nodes)
        self.depth = np.arange(nodes) - self.first[owner]
        at = np.flatnonzero(left)
        whole, state, size, found = at, np.zeros(len(at), np.int32), 0, []
        while len(at):
            state = v.step(state, chars[at + size])
            ok = state >= 0
            at, state, size = at[ok], state[ok], size + 1
            piece = v.piece[state]
            is_piece = piece >= 0
            found.append((at[is_piece], size, piece[is_piece]))
        alone = np.zeros(nodes, bool)
        alone[found[0][0] if found else []] = True
        lost = whole[~alone[whole]]  # a character that is no piece goes by its bytes
        flat, place = [np.arange(len(v.raw))], {}
        for c in np.unique(chars[lost]).tolist():
            ids = [v.byte_ids[x] for x in chr(c).encode()]
            place[c] = (sum(map(len, flat)), len(ids))
            flat.append(np.array(ids))
        extra = np.array([place[c] for c in chars[lost].tolist()], np.int32).reshape(-1, 2)
        src = np.concatenate([*(f[0] for f in found), lost]).astype(np.int32)
        to = np.concatenate([*(f[0] + f[1] for f in found), lost + 1]).astype(np.int32)
        flat_at = np.concatenate([*(f[2] for f in found), extra[:, 0]]).astype(np.int32)
        width = np.concatenate([*(np.ones(len(f[0]), np.int32) for f in found), extra[:, 1]]).astype(np.int32)
        order = np.argsort(src, kind="stable")
        self.src, self.to, self.flat_at, self.width, self.flat = src[order], to[order], flat_at[order], width[order], np.concatenate(flat).astype(np.int32)
        src = self.src
        weight = np.where(self.flat_at < len(v.raw), v.weight[np.minimum(self.flat_at, len(v.raw) - 1)], v.byte_weight * self.width)
        degree = np.bincount(src, minlength=nodes)
        self.begin = np.concatenate([[0], np.cumsum(degree)])
        total = np.zeros(nodes)  # log of the weights of all ways to the end
        inner = np.flatnonzero(degree)
        inner = inner[np.argsort(left[inner].astype(np.uint16 if left.max(initial=0) < 1 << 16 else np.int64), kind="stable")]
        many = degree[inner]
        starts = np.cumsum(many) - many
        by_left = np.repeat(self.begin[inner] - starts, many) + np.arange(len(src))
        weights, ends = weight[by_left], self.to[by_left]
        levels = np.flatnonzero(np.diff(left[inner], prepend=0, append=nodes + 1)).tolist()
        edges = [*starts[levels[:-1]].tolist(), len(src)]
        for a, b, low, high in zip(levels, levels[1:], edges, edges[1:]):
            cut, value = starts[a:b] - low, weights[low:high] + total[ends[low:high]]
            top = np.maximum.reduceat(value, cut)
            total[inner[a:b]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, many[a:b])), cut))
        self.logp = weight + total[self.to] - total[src]
        upto = np.cumsum(np.exp(self.logp))
        before = np.concatenate([[0.0], upto])[self.begin[:-1]]
        self.ladder = src + np.minimum(upto - before[src], 1.0)
        inner = np.flatnonzero(degree)
        final = self.begin[inner + 1] - 1
        self.ladder[final] = src[final] + 1.0
        top = np.maximum.reduceat(self.logp, self.begin[inner]) if len(inner) else np.zeros(0)
        self.top = np.zeros(nodes)  # probability of each node's likeliest edge, that edge, and the ladder below it
        self.top[inner] = np.exp(top)
        hit = np.flatnonzero(self.logp == np.repeat(top, degree[inner]))
        self.best = np.zeros(nodes, np.int32)
        self.best[src[hit[::-1]]] = hit[::-1]
        self.below = upto[self.best] - np.exp(self.logp[self.best]) - before if len(upto) else np.zeros(nodes)

    def add(self, more: Lattices, pieces: int) -> None:
        """Appends other lattices of the same vocabulary of ``pieces`` pieces."""
        nodes, edges, flat = len(self.depth), len(self.src), len(self.flat)
        far = more.flat_at >= pieces
        more.flat_at[far] += flat - pieces
        shift = {"first": nodes, "last": nodes, "depth": 0, "src": nodes, "to": nodes, "flat_at": 0, "width": 0, "logp": 0, "ladder": nodes, "top": 0, "best": edges, "below": 0}
        for name, by in shift.items():
            new = getattr(more, name)
            setattr(self, name, np.concatenate([getattr(self, name), new + new.dtype.type(by)]))
        self.begin = np.concatenate([self.begin[:-1], more.begin + edges])
        self.flat = np.concatenate([self.flat, more.flat[pieces:]])

    def draw(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node by its number in (0, 1): the likeliest for the least numbers, else one found on the ladder."""
        top, edge = self.top[at], self.best[at]
        rest = np.flatnonzero(u >= top)
        a, x = at[rest], u[rest] - top[rest]
        x += np.where(x < self.below[a], 0, top[rest])
        e = np.searchsorted(self.ladder, a + np.minimum(x, 1 - 1e-12), side="right")
        edge[rest] = np.clip(e, self.begin[a], self.begin[a + 1] - 1)
        return edge


def _uniform(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1), each a function of key and place."""
    x = key + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0xD6E8FEB86659FD93), (32, 0xD6E8FEB86659FD93)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x >> np.uint64(11)) + 0.5) * 2.0**-53


@dataclass
class Walks:
    """Token edges of one path for each of some texts, one after the other, and each token's part (counted within its text)."""

    texts: np.ndarray
    bounds: np.ndarray
    edges: np.ndarray
    parts: np.ndarray
    value: np.ndarray
    #: Log-probabilities of the tokens, summed up: what token t adds is ``upto[t + 1] - upto[t]``.
    upto: np.ndarray


class Store:
    """Lattices of the parts that a task has met."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.numbers, self.lattices = v, Numbers(), None

    def chains(self, texts: list[str]) -> tuple[list[np.ndarray], Lattices]:
        """Each text's parts by number, and lattices that hold these parts."""
        if self.lattices is not None and len(self.lattices.src) > EDGES:
            self.numbers, self.lattices = Numbers(), None
        known = len(self.numbers)
        chains = [np.fromiter(map(self.numbers.__getitem__, PART.findall((SPACE + t).replace(" ", SPACE))), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        if self.lattices is None or len(self.numbers) > known:
            more = Lattices(self.v, list(self.numbers)[known:])
            if self.lattices is None:
                self.lattices = more
            else:
                self.lattices.add(more, len(self.v.raw))
        return chains, self.lattices


class Search:
    """Perturbed best-first search over the lattices of a block's texts, one step of all texts at a time."""

    def __init__(self, store: Store, texts: list[str], seeds: list[int]) -> None:
        self.chain, self.l = store.chains(texts)
        sizes = self.l.last - self.l.first
        self.place = [np.concatenate([[0], np.cumsum(sizes[c])]) for c in self.chain]
        self.at = np.cumsum([0, *(len(p) for p in self.place)])
        self.places = np.concatenate([*self.place, np.zeros(0, np.int64)]).astype(np.int64)
        self.seeds = np.array(seeds, np.uint64)
        self.heads = self.values = None  # queued branches: (text, path, token, edge or -1 for all from that token on), and their values

    def tails(self, who: list[tuple[int, int, int]], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Samples on from (text, part, node) to the texts' ends: edges, their parts, and bounds of each text's."""
        l, sizes, nodes, own, place, number = self.l, [], [], [], [], []
        for i, part, node in who:
            rest = self.chain[i][part:]
            at = l.first[rest]
            if len(rest) and node >= 0:
                at[0] = node
            sizes.append(len(rest))
            nodes.append(at)
            own.append(rest)
            place.append(self.place[i][part:-1])
            number.append(np.arange(part, part + len(rest)))
        node, own, place, number = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (nodes, own, place, number))
        key, end, live = np.repeat(keys, sizes), l.last[own], np.arange(len(node))
        steps, count = [], np.zeros(len(node), np.int64)
        while len(live):
            at = node[live]
            e = l.draw(at, _uniform(key[live], place[live] + l.depth[at]))
            steps.append((live, e))
            count[live] += 1
            node[live] = l.to[e]
            live = live[node[live] != end[live]]
        offset = np.concatenate([[0], np.cumsum(count)])
        edges = np.zeros(offset[-1], np.int64)
        for n, (at, e) in enumerate(steps):
            edges[offset[at] + n] = e
        return edges, np.repeat(number, count), offset[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]

    def branches(self, path: int, w: Walks, row: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What path ``w`` of the texts at ``row`` passes from token ``begin`` on: heads, log-probabilities, places of noise.

        Branches are single ones until the prefix has lost CUT nats; those of all later tokens are one head.
        """
        l, first, end = self.l, w.bounds[row], w.bounds[row + 1]
        a = np.minimum(first + begin, end)
        cut = np.clip(np.searchsorted(-w.upto, -w.upto[a] + CUT), np.minimum(a + 1, end), end)
        many = cut - a
        own = np.repeat(np.arange(len(row)), many)
        t = np.repeat(a, many) + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        degree = l.begin[l.src[w.edges[t]] + 1] - l.begin[l.src[w.edges[t]]]
        t, own, many = t[degree > 1], own[degree > 1], degree[degree > 1]
        own, t, nth = np.repeat(own, many), np.repeat(t, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        e = l.begin[l.src[w.edges[t]]] + nth
        other = e != w.edges[t]
        own, t, e, nth = own[other], t[other], e[other], nth[other]
        rest = np.flatnonzero(cut < end)
        with np.errstate(divide="ignore"):
            mass = w.upto[cut[rest]] - w.upto[first[rest]] + np.log(-np.expm1(w.upto[end[rest]] - w.upto[cut[rest]]))
        rest, mass = rest[mass > -np.inf], mass[mass > -np.inf]
        logp = np.concatenate([w.upto[t] - w.upto[first[own]] + l.logp[e], mass])
        own, t = np.concatenate([own, rest]), np.concatenate([t, cut[rest]])
        e, nth = np.concatenate([e, np.full(len(rest), -1)]), np.concatenate([nth, np.full(len(rest), 4095)])
        text = w.texts[row[own]]
        chars = self.places[self.at[text] + w.parts[t]] + l.depth[l.src[w.edges[t]]]
        return np.stack([text, np.full(len(t), path), t - first[own], e], axis=1), logp, chars * 4096 + nth

    def insert(self, heads: np.ndarray, values: np.ndarray, keep: int) -> None:
        """Queues heads; keeps the ``keep`` best of each text."""
        if self.heads is not None:
            heads, values = np.concatenate([self.heads, heads]), np.concatenate([self.values, values])
        order = np.lexsort((-values, heads[:, 0]))
        text = heads[order, 0]
        order = order[np.arange(len(order)) - np.searchsorted(text, text) < keep]
        self.heads, self.values = heads[order], values[order]

    def noise(self, text: np.ndarray, salt: int, place: np.ndarray) -> np.ndarray:
        """log(-log u), the negative of a standard Gumbel variable."""
        return np.log(-np.log(_uniform(self.seeds[text] ^ np.uint64(salt & M64), place)))

    def queue(self, path: int, w: Walks, begin: np.ndarray, keep: int) -> None:
        """Queues what path ``w`` passes from token ``begin`` of each text on; keeps the ``keep`` best of each text.

        Given that the greatest value below a node is G, that of another edge is a Gumbel variable at its log-probability, cut at G.
        """
        heads, logp, place = self.branches(path, w, np.arange(len(w.texts)), begin)
        noise = self.noise(heads[:, 0], (path + 1) * 0x632BE59BD9B4E019, place)
        cap = w.value[np.searchsorted(w.texts, heads[:, 0])]
        self.insert(heads, -np.logaddexp(-cap, noise - logp), keep)

    def split(self, out: list[Walks], keep: int) -> None:
        """Replaces sets of branches at the head of a text's queue by their branches, of which one has the set's value."""
        while len(self.heads):
            lead = np.flatnonzero(np.diff(self.heads[:, 0], prepend=-1))
            lead = lead[self.heads[lead, 3] < 0]
            if not len(lead):
                return
            heads, values = self.heads[lead], self.values[lead]
            self.heads, self.values = np.delete(self.heads, lead, axis=0), np.delete(self.values, lead)
            for (i, path, token, _), value in zip(heads.tolist(), values.tolist(), strict=True):
                w = out[path]
                new, logp, place = self.branches(path, w, np.searchsorted(w.texts, [i]), np.array([token]))
                draw = [self.noise(new[:, 0], (path + 1) * 0x9FB21C651E98DF25 + salt, place) - logp for salt in (0, 1)]
                got = -np.logaddexp(-value, draw[1])
                got[np.argmin(draw[0])] = value
                self.insert(new, got, keep)

    def best(self, k: int) -> tuple[list[Walks], np.ndarray]:
        """The ``k`` best paths of each text that has so many, and the value of the next (-inf for none)."""
        l = self.l
        texts = np.array([i for i, c in enumerate(self.chain) if len(c)], np.int64)
        keys = lambda who, s: self.seeds[who] + np.uint64((s + 1) * 0x9E3779B97F4A7C15 & M64)
        edges, parts, bounds = self.tails([(i, 0, -1) for i in texts.tolist()], keys(texts, 0))
        first = -np.log(-np.log(_uniform(self.seeds[texts], np.full(len(texts), 1 << 40))))
        upto = lambda e: np.concatenate([[0.0], np.cumsum(np.minimum(l.logp[e], 0))])
        out = [Walks(texts, bounds, edges, parts, first, upto(edges))]
        self.queue(0, out[0], np.zeros(len(texts), np.int64), k)
        for s in range(1, k):
            self.split(out, k - s)
            lead = np.flatnonzero(np.diff(self.heads[:, 0], prepend=-1))
            heads, value = self.heads[lead], self.values[lead]
            self.heads, self.values = np.delete(self.heads, lead, axis=0), np.delete(self.values, lead)
            start, who = [], []
            for i, path, token, e in heads.tolist():
                w = out[path]
                a = int(w.bounds[np.searchsorted(w.texts, i)])
                part, node = int(w.parts[a + token]), int(l.to[e])
                if node == l.last[self.chain[i][part]]:
                    who.append((i, part + 1, -1))
                else:
                    who.append((i, part, node))
                start.append((np.append(w.edges[a : a + token], e), w.parts[a : a + token + 1]))
            edges, parts, bounds = self.tails(who, keys(heads[:, 0], s))
            pieces = [(x, edges[bounds[j] : bounds[j + 1]]) for j, (x, _) in enumerate(start)]
            own = [(x, parts[bounds[j] : bounds[j + 1]]) for j, (_, x) in enumerate(start)]
            flat = lambda pairs: np.concatenate([*(y for x in pairs for y in x), np.zeros(0, np.int64)])
            edges = flat(pieces)
            w = Walks(heads[:, 0], np.concatenate([[0], np.cumsum([len(a) + len(b) for a, b in pieces])]).astype(np.int64), edges, flat(own), value, upto(edges))
            out.append(w)
            self.queue(s, w, np.array([len(x) for x, _ in start], np.int64), k - s)
        bound = np.full(len(self.chain), -np.inf)
        if len(self.heads):
            lead = np.flatnonzero(np.diff(self.heads[:, 0], prepend=-1))
            bound[self.heads[lead, 0]] = self.values[lead]
        return out, bound


def sample(store: Store, texts: list[str], seeds: list[int], k: int) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """(text, sample, pieces, log_prob, perturbed, log_inclusion) by text and sample; all ids, and where each sample's begin."""
    found = Search(store, texts, seeds)
    l, rows, runs = found.l, [], []
    walks, bound = found.best(k) if any(texts) else ([], np.zeros(len(texts)))
    for s, w in enumerate(walks):
        logp = w.upto[w.bounds[1:]] - w.upto[w.bounds[:-1]]
        for j, (i, lp, value) in enumerate(zip(w.texts.tolist(), logp.tolist(), w.value.tolist(), strict=True)):
            x = lp - bound[i]
            known = 0.0 if x > 700 else x if x < -30 else math.log(-math.expm1(-math.exp(x)))
            rows.append((i, s, lp, value, known))
            runs.append(w.edges[w.bounds[j] : w.bounds[j + 1]])
    for i, t in enumerate(texts):
        if not t:
            rows.append((i, 0, 0.0, 0.0, 0.0))
            runs.append(np.zeros(0, np.int64))
    order = sorted(range(len(rows)), key=lambda i: rows[i][:2])
    edges = np.concatenate([*(runs[i] for i in order), np.zeros(0, np.int64)])
    width = l.width[edges]
    run = np.concatenate([[0], np.cumsum(width)])
    ids = l.flat[np.repeat(l.flat_at[edges] - run[:-1], width) + np.arange(run[-1])]
    bounds = run[np.concatenate([[0], np.cumsum([len(runs[i]) for i in order])]).astype(np.int64)]
    return [(*rows[i][:2], int(bounds[j + 1] - bounds[j]), *rows[i][2:]) for j, i in enumerate(order)], ids, bounds


def decoded(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> pa.StringArray:
    """The texts of runs of ids, without the space of their own that they begin with."""
    size = v.sizes[ids].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    data = v.joined[np.repeat(v.begins[ids] - ends[:-1], size) + np.arange(ends[-1])]
    full = np.diff(bounds) > 0
    start = ends[bounds[:-1]]
    data = np.delete(data, start[full])
    offsets = ends[bounds] - np.concatenate([[0], np.cumsum(full)])
    return pa.StringArray.from_buffers(len(full), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


_SAMPLES = "key string, sample int, n_pieces int, log_prob double, perturbed double, log_inclusion double, ids array<int>"


def encode(docs: DataFrame, vocabulary: Vocabulary, k: int = 2, seed: int = 0, key: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """key (as text), sample (from 0, best first), n_pieces, log_prob, perturbed, log_inclusion, ids: up to ``k`` rows per row.

    With ``texts``, ``decoded`` follows: what the ids decode to, as ``decode`` gives it, without a second pass through Python.

    ``log_inclusion`` is the log of 1 - exp(-exp(log_prob - next)), the chance of being sampled given the next perturbed value; 0 for
    a text with no more than ``k`` segmentations. As SentencePiece does, a text begins with a space of its own and spaces become
    U+2581 (one in a text is read as a space). A null or empty text has one segmentation, without pieces. A null key counts as
    empty; rows with equal key and text get equal samples. An empty table gives no rows. Other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(held.value)
        for b in batches:
            keys, sizes, at = b.column(0).to_pylist(), pc.fill_null(pc.utf8_length(b.column(1)), 0).to_pylist(), 0
            while at < len(keys):
                upto, size = at, 0
                while upto < len(keys) and (upto == at or size + sizes[upto] <= BLOCK_CHARS // k):
                    size, upto = size + sizes[upto], upto + 1
                seeds = [xxhash.xxh3_64_intdigest(x, seed=seed) for x in keys[at:upto]]
                rows, ids, bounds = sample(store, [t or "" for t in b.column(1).slice(at, upto - at).to_pylist()], seeds, k)
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array([keys[at + i] for i in cols[0]], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), *(pa.array(c, pa.float64()) for c in cols[3:]), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*arrays, *([decoded(held.value, ids, bounds)] if texts else [])], names=["key", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids", *(["decoded"] if texts else [])])
                at = upto

    return docs.select(key_text(key).alias("key"), F.col(text).alias("t")).mapInArrow(released(sampled), _SAMPLES + ", decoded string" * texts)


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> Column:
    """A column expression: the text of each array of ids; null for null, empty for none."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf(T.StringType())
    def text(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else held.value.decode(x.tolist()) for x in s], dtype=object)

    return text(F.col(ids))
