"""SentencePiece encoding, decoding, and sampling of distinct segmentations.

Sampling is a Gumbel top-k search without replacement over the lattice of a
text's pieces.  Backward sums over the lattice give every edge its conditional
probability, so a path drawn edge by edge is the leaf with the largest
perturbed log probability of its subtree.  The siblings passed on the way form
the frontier: each set of siblings gets the maximum of its Gumbels, truncated
at its parent's, and the best of the frontier is opened next, as A* does with
an exact bound.  The k best leaves are a sample without replacement, and the
best bound left over is the threshold of their inclusion probabilities.

No piece crosses the places where a word ends and white space begins, or
touches a line break, so every path passes there, and equal words
share one lattice.  Lattices are built for the distinct words of a block of
texts and walked by all its words at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import tidy

SPACE = "▁"
#: So many characters are handled at once; a longer text is a block of its own.
BLOCK = 1_000_000
#: Sums over words up to this length stay within doubles when scaled.
_LINEAR = 150
#: Scale for each character, about what a piece's log probability is per character.
_PER_CHAR = 1.6
K = 2


class Vocabulary:
    """Pieces of a model file as a trie in arrays, with log probabilities.

    Byte-pair models store merge ranks, no probabilities: piece number r of
    the file gets the Zipf-Mandelbrot weight 1 / (r + 2.7), raised to
    ``power`` and normalised.  Characters that no piece covers are spelled in
    byte pieces.
    """

    def __init__(self, raw: bytes, power: float = 0.5):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        own = self.library
        n = own.get_piece_size()
        pieces = [own.id_to_piece(i) for i in range(n)]
        normal = [not (own.is_control(i) or own.is_unknown(i) or own.is_unused(i) or own.is_byte(i)) for i in range(n)]
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p, ok in zip(pieces, normal) if ok and len(p) > 1):
            raise ValueError("a piece crosses the end of a word or a line; words have no lattices of their own")
        for probe in ("a  b", " x ", "éﬁ½", "a\nb\tc"):
            if own.normalize(probe) != normalise(probe):
                raise ValueError("the model normalises its input")
        weight = 1.0 / (np.arange(n) + 2.7) ** power
        self.logp = np.log(weight / weight[normal].sum())
        byte = {int(p[3:-1], 16): i for i, p in enumerate(pieces) if own.is_byte(i)}
        self.byte = np.array([byte.get(b, own.unk_id()) for b in range(256)], dtype=np.int32)
        self.byte_logp = float(self.logp.min())
        self.text = [bytes([int(p[3:-1], 16)]) if own.is_byte(i) else b"" if not normal[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]

        chars = sorted({c for p, ok in zip(pieces, normal) if ok for c in p})
        self.classes = np.zeros(0x110000, dtype=np.int32)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        step: dict[int, int] = {}
        ends: dict[int, int] = {}
        self.n_classes = len(chars) + 1
        for i, p in enumerate(pieces):
            if not normal[i]:
                continue
            state = 0
            for c in p:
                state = step.setdefault(state * self.n_classes + int(self.classes[ord(c)]), len(step) + 1)
            ends.setdefault(state, i)
        self.piece_at = np.full(len(step) + 1, -1, dtype=np.int32)
        self.piece_at[list(ends)] = list(ends.values())
        bits = max(8, (4 * len(step)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.next = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        mask = (1 << bits) - 1
        for key, state in step.items():
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & mask
            self.keys[at], self.next[at] = key, state

        self.store = Store(self)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def follow(self, states: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The states reached, -1 where the trie ends."""
        keys = states.astype(np.int64) * self.n_classes + classes
        at, out = self._slot(keys), np.full(len(keys), -1, dtype=np.int32)
        rest = np.arange(len(keys))
        while len(rest):
            held = self.keys[at]
            hit = held == keys
            out[rest[hit]] = self.next[at[hit]]
            go = ~hit & (held >= 0)
            rest, keys, at = rest[go], keys[go], (at[go] + 1) & (len(self.keys) - 1)
        return out

    def decode(self, ids: Sequence[int]) -> bytes:
        """UTF-8 of the text that the pieces spell, without the leading space that encoding adds."""
        table = self.text
        return b"".join([table[i] for i in ids]).removeprefix(b" ")


def normalise(text: str) -> str:
    """What the pieces spell: a space in front, spaces made visible; empty stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


class Lattices:
    """The lattices of distinct words, laid end to end.

    A node is a place in a word, its end included; ``first`` and ``last``
    are the nodes of a word's ends.  A node's edges are ``off[node]`` to
    ``off[node + 1]``.
    """

    def __init__(self, vocabulary: Vocabulary, codes: np.ndarray, sizes: np.ndarray):
        v = vocabulary
        word_of = np.repeat(np.arange(len(sizes)), sizes)
        end_of = np.repeat(np.cumsum(sizes), sizes)
        classes = v.classes[np.minimum(codes, 0x10FFFF)]
        starts, states, found, depth = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int32), [], 0
        while len(starts):
            states = v.follow(states, classes[starts + depth])
            alive = states >= 0
            starts, states = starts[alive], states[alive]
            depth += 1
            pieces = v.piece_at[states]
            has = pieces >= 0
            if depth == 1:
                lone = np.ones(len(codes), dtype=bool)
                lone[starts[has]] = False
                spelled = np.flatnonzero(lone)
                lengths8 = np.select([codes[spelled] < 0x80, codes[spelled] < 0x800, codes[spelled] < 0x10000], [1, 2, 3], 4)
                found.append((spelled, np.full(len(spelled), -1, dtype=np.int32), v.byte_logp * lengths8, 1))
            found.append((starts[has], pieces[has], v.logp[pieces[has]], depth))
            more = starts + depth < end_of[starts]
            starts, states = starts[more], states[more]
        n_nodes = len(codes) + len(sizes)
        self.first = np.cumsum(sizes + 1) - (sizes + 1)
        self.last = self.first + sizes
        counts = np.zeros(n_nodes + 1, dtype=np.int64)
        for s, *_ in found:
            counts[s + word_of[s] + 1] += 1
        self.off = np.cumsum(counts)
        total = int(self.off[-1])
        used = np.zeros(n_nodes, dtype=np.int16)
        self.piece, self.step = np.empty(total, dtype=np.int32), np.empty(total, dtype=np.int8)
        self.code = np.zeros(n_nodes, dtype=np.uint32)
        self.code[np.arange(len(codes)) + word_of] = codes
        logw, node = np.empty(total), np.empty(total, dtype=np.int32)
        for s, piece, lp, length in found:
            at = s + word_of[s]
            e = self.off[at] + used[at]
            used[at] += 1
            self.piece[e], self.step[e], logw[e], node[e] = piece, length, lp, at
        self._conditional(logw, node, sizes)

    def _conditional(self, logw: np.ndarray, node: np.ndarray, sizes: np.ndarray) -> None:
        """Each edge's probability given its node, from backward sums; running sums within a node."""
        n_nodes = len(self.off) - 1
        left = np.zeros(n_nodes, dtype=np.int64)  # characters to the word's end
        word_of = np.repeat(np.arange(len(sizes)), sizes + 1)
        left[:] = self.last[word_of] - np.arange(n_nodes)
        long = (sizes > _LINEAR)[word_of]
        prob = np.empty(len(logw))
        for logs in (False, True):
            own = long[node] if logs else ~long[node]
            if not own.any():
                continue
            edges = np.flatnonzero(own)
            key = left[node[edges]]
            edges = edges[np.argsort(key.astype(np.uint16) if key.max() < 1 << 16 else key, kind="stable")]
            key = left[node[edges]]
            bounds = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
            w = logw if logs else np.exp(logw + _PER_CHAR * self.step)
            back = np.zeros(n_nodes) if logs else np.ones(n_nodes)
            for a, b in zip(bounds[:-1], bounds[1:]):
                e = edges[a:b]
                at = node[e]
                heads = np.flatnonzero(np.diff(at, prepend=-1))
                through = back[at + self.step[e]]
                if logs:
                    back[at[heads]] = np.logaddexp.reduceat(w[e] + through, heads)
                else:
                    back[at[heads]] = np.add.reduceat(w[e] * through, heads)
            e = edges
            if logs:
                prob[e] = np.exp(w[e] + back[node[e] + self.step[e]] - back[node[e]])
            else:
                prob[e] = w[e] * back[node[e] + self.step[e]] / back[node[e]]
        self.prob = np.clip(prob, 1e-300, 1.0)
        # summed within each node, so what lies before it in the block doesn't show
        self.upto = prob.copy()
        rank = np.arange(len(prob)) - self.off[node]
        later = np.flatnonzero(rank > 0)
        by_rank = later[np.argsort(rank[later].astype(np.int16), kind="stable")]
        bounds = np.searchsorted(rank[by_rank], np.arange(1, int(rank.max(initial=0)) + 2))
        for a, b in zip(bounds[:-1], bounds[1:]):
            e = by_rank[a:b]
            self.upto[e] += self.upto[e - 1]
        ends = self.off[1:][np.diff(self.off) > 0] - 1
        self.upto[ends] = 2.0  # the last edge takes whatever is left
        only = np.diff(self.off)[node] == 1
        self.prob[only] = 1.0

    def choose(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge from each node, by a uniform number."""
        e = self.off[nodes]
        act = np.flatnonzero(u >= self.upto[e])
        while len(act):
            e[act] += 1
            act = act[u[act] >= self.upto[e[act]]]
        return e

    def walk(self, nodes: np.ndarray, last: np.ndarray, place: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Draw paths from ``nodes`` to ``last``.

        ``place`` is where each starts in the block's characters, whose
        uniform numbers are ``u``.  Returns edges, their starts in the
        characters, and path numbers, path by path.
        """
        who, steps = np.flatnonzero(nodes < last), []
        counts = np.zeros(len(nodes), dtype=np.int64)
        nodes, place = nodes[who], place[who]
        goal = last[who]
        while len(who):
            e = self.choose(nodes, u[place])
            steps.append((who, e, place))
            counts[who] += 1
            by = self.step[e]
            nodes, place = nodes + by, place + by
            go = nodes < goal
            who, nodes, place, goal = who[go], nodes[go], place[go], goal[go]
        offsets = np.cumsum(counts) - counts
        edges, at = np.empty(counts.sum(), dtype=np.int64), np.empty(counts.sum(), dtype=np.int64)
        for i, (w, e, p) in enumerate(steps):
            edges[offsets[w] + i], at[offsets[w] + i] = e, p
        return edges, at, counts


class Store:
    """Lattices of the words met so far, for a worker's later blocks.

    The first ``most`` distinct words stay; those of a block that come later
    are laid behind them and overwritten by the next block.  What a word's
    lattice is doesn't depend on when it was built.  Words are found by a
    hash of their characters and then compared.
    """

    WORDS, NODES, EDGES = ("first", "last"), ("off", "code"), ("piece", "step", "prob", "upto")

    def __init__(self, vocabulary: Vocabulary, most: int = 60_000):
        self.vocabulary, self.most = vocabulary, most
        self.hashes, self.places = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)  # of words that stay, by hash
        self.ends = (0, 0, 0)  # words, nodes and edges that stay
        empty = Lattices(vocabulary, np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))
        self.arrays = {n: getattr(empty, n) for n in (*self.WORDS, *self.NODES, *self.EDGES)}
        self.factors = np.zeros(0, dtype=np.uint64)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        held = self.arrays[name]
        if at + len(values) > len(held):
            grown = np.empty(int(1.3 * (at + len(values))) + 1, dtype=held.dtype)
            grown[:at] = held[:at]
            held = self.arrays[name] = grown
        held[at : at + len(values)] = values

    def block(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[Lattices, np.ndarray]:
        """Lattices that hold the words at ``starts``, and each word's place in them."""
        within = np.arange(len(codes)) - np.repeat(starts, sizes)
        if len(sizes) and sizes.max() > len(self.factors):
            self.factors = np.random.default_rng(7).integers(1, 1 << 63, size=2 * int(sizes.max()), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if len(sizes):
            hashes = np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * self.factors[within], starts)
        else:
            hashes = np.zeros(0, dtype=np.uint64)
        distinct, example, word = np.unique(hashes, return_index=True, return_inverse=True)
        out, place = self._lay(codes, starts, sizes, within, distinct, example)
        word = place[word]
        if not np.array_equal((out.last - out.first)[word], sizes) or not np.array_equal(out.code[np.repeat(out.first[word], sizes) + within], codes):
            # two words with one hash: every word gets a lattice of its own
            return Lattices(self.vocabulary, codes, sizes), np.arange(len(sizes))
        return out, word

    def _lay(self, codes, starts, sizes, within, distinct, example) -> tuple[Lattices, np.ndarray]:
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == distinct
        w0, n0, e0 = self.ends
        fresh = example[~known]
        chosen = np.repeat(starts[fresh], sizes[fresh]) + _ramp(sizes[fresh])
        new = Lattices(self.vocabulary, codes[chosen], sizes[fresh])
        for name, to, shift in (("first", w0, n0), ("last", w0, n0), ("off", n0, e0), ("code", n0, 0), *((x, e0, 0) for x in self.EDGES)):
            values = getattr(new, name)
            self._put(name, to, values + shift if shift else values)
        ends = w0 + len(new.first), n0 + len(new.code), e0 + len(new.piece)
        place = np.empty(len(distinct), dtype=np.int64)
        place[known] = self.places[at[known]]
        place[~known] = w0 + np.arange(len(fresh))
        if ends[0] <= self.most:
            hashes, places = np.concatenate([self.hashes, distinct[~known]]), np.concatenate([self.places, place[~known]])
            order = np.argsort(hashes)
            self.hashes, self.places, self.ends = hashes[order], places[order], ends
        out = Lattices.__new__(Lattices)
        for names, end in ((self.WORDS, ends[0]), (("off",), ends[1] + 1), (("code",), ends[1]), (self.EDGES, ends[2])):
            for name in names:
                setattr(out, name, self.arrays[name][:end])
        return out, place


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def lay_out(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of the normalised texts, where words start, and where texts do (and end).

    A word is spaces and what follows them, a run of line breaks, or what
    follows these.
    """
    spelled = [normalise(t) for t in texts]
    codes = np.frombuffer("".join(spelled).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bounds = np.cumsum([0, *map(len, spelled)])
    kind = np.where(codes == ord(SPACE), 1, np.where(codes == 10, 2, 0)).astype(np.int8)
    new = np.zeros(len(codes), dtype=bool)
    new[1:] = (kind[1:] != kind[:-1]) & ((kind[1:] > 0) | (kind[:-1] == 2))
    new[bounds[:-1][bounds[:-1] < len(codes)]] = True
    return codes, np.flatnonzero(new), bounds


def row_seed(key: object, seed: int) -> int:
    return xxhash.xxh64_intdigest(("null" if key is None else str(key)).encode(), seed)


def sample_block(v: Vocabulary, keys: Sequence[object], texts: Sequence[str], k: int = K, seed: int = 0) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to ``k`` tuples: ids, log probability, perturbed value, log inclusion.

    They are distinct segmentations in the order of their perturbed values.
    A text with fewer segmentations gets all of them, and the log inclusion
    of all is 0.  The draws depend on the row's key and the text only.
    """
    codes, place, chars_to = lay_out(texts)
    n_chars = len(codes)
    sizes = np.diff(place, append=n_chars)
    grid, word = v.store.block(codes, place, sizes)
    words_to = np.searchsorted(place, chars_to)
    first, last = grid.first[word], grid.last[word]
    draws = [np.random.Generator(np.random.Philox(key=row_seed(key, seed))) for key in keys]

    def uniform(docs: Sequence[int]) -> np.ndarray:
        out = np.zeros(n_chars)
        for d in docs:
            out[chars_to[d] : chars_to[d + 1]] = draws[d].random(chars_to[d + 1] - chars_to[d])
        return out

    every = list(range(len(texts)))
    edges, at, counts = grid.walk(first, last, place, uniform(every))
    edge_to = np.append(0, np.cumsum(counts))[words_to]
    paths: list[list] = []
    for d in every:
        root = float(-np.log(draws[d].standard_exponential()))
        a, b = edge_to[d], edge_to[d + 1]
        paths.append([_Path(grid, edges[a:b], at[a:b], 0, root, draws[d])])
    results = [[p[0]] for p in paths]
    for turn in range(1, k + 1):
        # open the best of each frontier; the last turn only asks for its bound
        opened = []
        for d in every:
            best = max(paths[d], key=lambda p: p.bound)
            if best.bound == -np.inf or len(results[d]) < turn:
                continue
            opened.append((d, best))
        if turn == k or not opened:
            break
        starts, goals, begins, owners = [], [], [], []
        heads = {}
        for d, path in opened:
            i, edge = path.open(draws[d])
            place_of = int(path.at[i])
            w = int(np.searchsorted(place[words_to[d] : words_to[d + 1]], place_of, side="right")) - 1 + words_to[d]
            node = first[w] + place_of - place[w]
            heads[d] = (path.edges[:i], path.at[:i], i, edge, place_of)
            rest = slice(w + 1, words_to[d + 1])
            starts += [np.array([node + int(grid.step[edge])]), first[rest]]
            goals += [last[w : w + 1], last[rest]]
            begins += [np.array([place_of + int(grid.step[edge])]), place[rest]]
            owners.append(words_to[d + 1] - w)
        tail, tail_at, tail_counts = grid.walk(np.concatenate(starts), np.concatenate(goals), np.concatenate(begins), uniform([d for d, _ in opened]))
        ends = np.append(0, np.cumsum(tail_counts))[np.append(0, np.cumsum(owners))]
        for j, (d, path) in enumerate(opened):
            head, head_at, i, edge, place_of = heads[d]
            part = slice(ends[j], ends[j + 1])
            new = _Path(grid, np.concatenate([head, [edge], tail[part]]), np.concatenate([head_at, [place_of], tail_at[part]]), i + 1, path.opened, draws[d])
            paths[d].append(new)
            results[d].append(new)
    out = []
    for d in every:
        threshold = max(p.bound for p in paths[d])
        rows = []
        for p in results[d]:
            x = p.log_prob - threshold
            # log(1 - exp(-exp(x))), whose first term is x where that is small
            inclusion = 0.0 if threshold == -np.inf else x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 50.0)))))
            rows.append((_ids(v, grid, p.edges, p.at, first, place), p.log_prob, p.value, inclusion))
        out.append(rows)
    return out


class _Path:
    """A leaf found, and the frontier that branches off it from level ``own`` on."""

    def __init__(self, grid: Lattices, edges: np.ndarray, at: np.ndarray, own: int, value: float, draw: np.random.Generator):
        self.grid, self.edges, self.at, self.own, self.value = grid, edges, at, own, value
        q = grid.prob[edges]
        lq = np.log(q)
        self.log_prob = float(lq.sum())
        before = np.cumsum(lq) - lq
        with np.errstate(divide="ignore"):
            mass = before[own:] + np.log1p(-q[own:])
        self.before = before
        noise = np.log(draw.standard_exponential(len(mass)))
        self.frontier = -np.logaddexp(-value, noise - mass)
        self.taken: dict[int, list[int]] = {}
        self.opened = -np.inf
        self._look()

    def _look(self) -> None:
        self.best = int(np.argmax(self.frontier)) if len(self.frontier) else -1
        self.bound = float(self.frontier[self.best]) if len(self.frontier) else -np.inf

    def open(self, draw: np.random.Generator) -> tuple[int, int]:
        """Take the best sibling set: its level, and the edge that holds its maximum."""
        i = self.own + self.best
        g, edge = self.grid, int(self.edges[self.own + self.best])
        node_edges = np.arange(*_span(g, edge))
        done = self.taken.setdefault(i, [edge])
        q = np.where(np.isin(node_edges, done), 0.0, g.prob[node_edges])
        run = np.cumsum(q)
        pick = int(node_edges[min(int(np.searchsorted(run, draw.random() * run[-1], side="right")), len(q) - 1)])
        while pick in done:
            pick -= 1
        done.append(pick)
        self.opened = self.bound
        rest = float(run[-1] - g.prob[pick])
        left = len(node_edges) > len(done) and rest > 0
        self.frontier[self.best] = -np.logaddexp(-self.opened, np.log(draw.standard_exponential()) - (self.before[i] + np.log(rest))) if left else -np.inf
        self._look()
        return i, pick


def _span(grid: Lattices, edge: int) -> tuple[int, int]:
    node = int(np.searchsorted(grid.off, edge, side="right")) - 1
    return int(grid.off[node]), int(grid.off[node + 1])


def _ids(v: Vocabulary, grid: Lattices, edges: np.ndarray, at: np.ndarray, first: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Piece numbers of a path; a character without a piece becomes its bytes."""
    ids = grid.piece[edges]
    spelled = np.flatnonzero(ids < 0)
    if not len(spelled):
        return ids
    w = np.searchsorted(place, at[spelled], side="right") - 1
    codes = grid.code[first[w] + at[spelled] - place[w]]
    parts, done = [], 0
    for i, c in zip(spelled.tolist(), codes.tolist()):
        parts += [ids[done:i], v.byte[list(chr(c).encode("utf-8", "replace"))]]
        done = i + 1
    return np.concatenate([*parts, ids[done:]])


def _blocks(keys: Sequence[object], texts: Sequence[str], size: int = BLOCK) -> Iterator[tuple[list, list]]:
    own_keys, own, held = [], [], 0
    for key, text in zip(keys, texts):
        if own and held + len(text) > size:
            yield own_keys, own
            own_keys, own, held = [], [], 0
        own_keys.append(key)
        own.append(text)
        held += len(text) + 1
    if own:
        yield own_keys, own


_LOADED: dict[tuple, Vocabulary] = {}


def vocabulary(raw: bytes, power: float = 0.5) -> Vocabulary:
    key = (xxhash.xxh64_intdigest(raw), power)
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(raw, power)
    return _LOADED[key]


def _sent(spark: SparkSession, path: str):
    raw = Path(path).read_bytes()
    if len(raw) > 64 << 20:
        raise ValueError(f"{path} is too large for a tokenizer file")
    return spark.sparkContext.broadcast(raw)


_SAMPLE = T.StructType([
    T.StructField("sample", T.IntegerType()), T.StructField("n_pieces", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("perturbed", T.DoubleType()),
    T.StructField("log_inclusion", T.DoubleType()), T.StructField("ids_digest", T.StringType()), T.StructField("round_trip", T.BooleanType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
])


def sample_column(spark: SparkSession, model_path: str, key: Column, text: Column, k: int = K, seed: int = 0, with_ids: bool = True) -> Column:
    """An array with up to ``k`` sampled segmentations of a text column.

    Null counts as empty, which has one segmentation, of no pieces.
    ``round_trip`` says that the pieces decode to the text; it is false only
    for texts that hold U+2581 itself, which encoding takes for a space.
    """
    sent = _sent(spark, model_path)
    kinds = pa.list_(pa.struct([("sample", pa.int32()), ("n_pieces", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64()), ("ids_digest", pa.string()), ("round_trip", pa.bool_()), ("ids", pa.list_(pa.int32()))]))

    @F.arrow_udf(T.ArrayType(_SAMPLE))
    def sampled(keys: pa.Array, texts: pa.Array) -> pa.Array:
        v = vocabulary(sent.value)
        columns: list[list] = [[] for _ in range(7)]
        numbers, ends, row_ends = [], [0], [0]
        for own_keys, own in _blocks(keys.to_pylist(), [x or "" for x in texts.to_pylist()]):
            for text, rows in zip(own, sample_block(v, own_keys, own, k, seed)):
                raw = text.encode("utf-8", "replace")
                for i, (ids, log_prob, value, inclusion) in enumerate(rows):
                    fine = v.decode(ids.tolist()) == raw
                    for c, x in zip(columns, (i, len(ids), log_prob, value, inclusion, f"{xxhash.xxh64_intdigest(ids.astype('<i4').tobytes()):016x}", fine)):
                        c.append(x)
                    if with_ids:
                        numbers.append(ids)
                    ends.append(ends[-1] + (len(ids) if with_ids else 0))
                row_ends.append(len(ends) - 1)
        flat = pa.array(np.concatenate(numbers) if numbers else np.zeros(0, np.int32), type=pa.int32())
        ids = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), flat)
        fields = kinds.value_type
        arrays = [pa.array(c, type=fields.field(j).type) for j, c in enumerate(columns)] + [ids]
        rows = pa.StructArray.from_arrays(arrays, fields=list(fields))
        return tidy(pa.ListArray.from_arrays(pa.array(row_ends, type=pa.int32()), rows))

    return sampled(key, text)


def sample(docs: DataFrame, model_path: str, key_col: str = "doc_id", text_col: str = "text", k: int = K, seed: int = 0, with_ids: bool = True) -> DataFrame:
    """``docs`` without its text, a row for each sampled segmentation.

    Null and empty texts have one segmentation, of no pieces; a long text is
    sampled whole.  Rows that repeat key and text get the same draws each;
    null keys count as one key.  Equal perturbed values, which doubles hardly
    give, go to the path found first.  An empty table gives an empty one.
    Columns of ``docs`` named like a field of a sample are replaced.
    """
    made = {f.name for f in _SAMPLE}
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text_col and c.lower() not in made]
    column = sample_column(docs.sparkSession, model_path, F.col(f"`{key_col}`"), F.col(f"`{text_col}`"), k, seed, with_ids)
    out = [f.name for f in _SAMPLE if with_ids or f.name != "ids"]
    return docs.select(*kept, F.explode(column).alias("sample__")).select(*kept, *[F.col(f"sample__.{c}").alias(c) for c in out])


def encode_column(spark: SparkSession, model_path: str, text: Column) -> Column:
    """The piece numbers that the model's library gives; null counts as empty."""
    sent = _sent(spark, model_path)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(texts: pa.Array) -> pa.Array:
        own = vocabulary(sent.value).library
        return pa.array([own.encode(x.as_py() or "") for x in texts], type=pa.list_(pa.int32()))

    return encoded(text)


def decode_column(spark: SparkSession, model_path: str, ids: Column) -> Column:
    """The text that an array of piece numbers spells; null stays null."""
    sent = _sent(spark, model_path)

    @F.arrow_udf(T.StringType())
    def decoded(rows: pa.Array) -> pa.Array:
        v = vocabulary(sent.value)
        return pa.array([None if x is None else v.decode(x).decode("utf-8", "replace") for x in rows.to_pylist()], type=pa.string())

    return decoded(ids)
