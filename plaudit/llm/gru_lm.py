"""Language-model scoring with a gated recurrent network, written in numpy.

The output is factored: a softmax over classes, then one over the words of the class. The most
frequent words have places in classes; every other word belongs to one of a few tail classes by its
shape, and inside it has its share of the smoothed word counts. So every word has a probability,
and the counts of the whole corpus are part of the model. Training runs in all tasks at once on all
tokens of all training documents, with truncated backpropagation; the weights are averaged after
every round. Training and scoring carry the state through a document from its first to its last
token.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.llm.common import bounded_batches, held_out, one_per_key, stored, table, text_of

#: The end of a document, as a word that no text holds.
END = b""
TAILS = 16
LOG10 = math.log(10)
#: Logits are cut here; exp of it is still a number, and trained ones stay far below.
LARGEST = np.float32(60)
#: Weights that Adam takes at a time: they stay in a core's cache.
CHUNK = 1 << 14
#: Documents scored side by side, and rows of hidden states whose words are: as many as a cache holds.
ABREAST, ROWS = 256, 4096
#: Key of documents without an id.
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class LmConfig:
    """``vocabulary`` words have a place in the network; the counts of ``known`` words are at
    hand in every task (both bounds on what is broadcast), those of rarer words are joined.
    Every training document is read from end to end in each round, ``lanes`` of them side by side
    in windows of ``window`` tokens. ``span`` has no effect any more."""

    vocabulary: int = 4096
    known: int = 1 << 17
    embedding: int = 24
    hidden: int = 32
    window: int = 32
    span: int = 64
    lanes: int = 64
    rounds: int = 1
    rate: float = 0.01
    folds: int = 10
    smoothing: float = 0.1
    block: int = 2048
    held_tokens: int = 4_000_000
    seed: int = 4


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts: words, A-Z lower-cased, then the end of each. Also where the tokens
    of each text begin, and where the last ones end."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    pieces = split.flatten().cast(pa.binary())
    filled = pc.binary_length(pieces).to_numpy() > 0  # blanks around a text leave empty pieces
    bounds = np.concatenate([[0], np.cumsum(filled)])[split.offsets.to_numpy()] + np.arange(len(texts) + 1)
    place = np.full(bounds[-1], len(pieces))
    word = np.ones(bounds[-1], bool)
    word[bounds[1:] - 1] = False
    place[word] = np.flatnonzero(filled)
    return pa.concat_arrays([pieces, pa.array([END], pa.binary())]).take(pa.array(place)), bounds


def tail_of(word: bytes) -> int:
    """Tail class of a word: letters beyond ASCII, mark at the end, length."""
    wide = not word.isascii()
    last = word[-1] if word else 0
    mark = not (97 <= last <= 122 or last > 127)
    size = len(word)
    return wide * 8 + mark * 4 + (0 if size < 5 else 1 if size < 8 else 2 if size < 12 else 3)


def tails_of(words: pa.Array) -> np.ndarray:
    """Tail class of each word."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size = np.diff(at)
    last = np.where(size > 0, np.take(np.append(data, np.uint8(0)), at[1:] - 1, mode="wrap"), 0)
    mark = ~((last >= 97) & (last <= 122) | (last > 127))
    wide = pc.utf8_length(words.view(pa.string())).to_numpy() < size
    return wide * 8 + mark * 4 + np.searchsorted([5, 8, 12], size, side="right")


def numbers_of(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Where each word stands among the known ones; -1 elsewhere."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()


@dataclass
class Vocabulary:
    """Counts of the training tokens. ``ids`` gives the network's words, ``counts`` those of all
    known words; ``mass`` is the smoothed share of the words of each tail class."""

    ids: dict[bytes, int]
    counts: dict[bytes, int]
    total: int
    distinct: int
    mass: np.ndarray
    smoothing: float

    @property
    def classes(self) -> int:
        return max(1, math.isqrt(max(1, len(self.ids))))

    @property
    def places(self) -> int:
        return -(-max(1, len(self.ids)) // self.classes)

    def base(self, count) -> float:
        return (count + self.smoothing) / (self.total + self.smoothing * (self.distinct + 1))


class Gru:
    """The network. Token ids below ``n_words`` are words (rank by count: class = rank modulo
    classes, place = rank // classes); the TAILS ids above are tail classes."""

    NAMES = ("emb", "wx", "wh", "b", "wc", "bc", "ww", "bw")

    def __init__(self, vocabulary: Vocabulary, config: LmConfig, weights: dict[str, np.ndarray] | None = None):
        self.n_words, self.c, self.s = len(vocabulary.ids), vocabulary.classes, vocabulary.places
        self.e, self.h, self.config = config.embedding, config.hidden, config
        self.w = weights if weights is not None else self._start(vocabulary)
        self._rooms: dict[str, np.ndarray] = {}

    def _start(self, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
        """Random recurrent weights, output weights of zero and biases that give the counts."""
        rng = np.random.default_rng(self.config.seed)
        share = np.zeros((self.s, self.c))
        for word, i in vocabulary.ids.items():
            share[i // self.c, i % self.c] = vocabulary.base(vocabulary.counts[word])
        in_class = share.sum(0)
        with np.errstate(divide="ignore"):
            bw = np.where(share > 0, np.log(np.maximum(share, 1e-300)) - np.log(np.maximum(in_class, 1e-300)), -1e4).T
            bc = np.log(np.maximum(np.concatenate([in_class, vocabulary.mass]), 1e-12))
        normal = lambda *shape: rng.normal(0, 1, shape)
        made = {
            "emb": normal(self.n_words + TAILS, self.e) * 0.3, "wx": normal(self.e, 3 * self.h) / math.sqrt(self.e),
            "wh": normal(self.h, 3 * self.h) / math.sqrt(self.h), "b": np.zeros(3 * self.h),
            "wc": np.zeros((self.h, self.c + TAILS)), "bc": bc, "ww": np.zeros((self.c, self.h, self.s)), "bw": bw,
        }
        return {k: v.astype(np.float32) for k, v in made.items()}

    def pack(self) -> bytes:
        return b"".join(self.w[k].tobytes() for k in self.NAMES)

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k in self.NAMES:
            size = self.w[k].size
            out[k] = flat[at : at + size].reshape(self.w[k].shape).astype(np.float32)
            at += size
        return out

    def _room(self, name: str, shape: tuple[int, ...], dtype) -> np.ndarray:
        """An array with any content; the memory is that of the last one called so, as new memory
        for each window costs as much as the work in it."""
        size = math.prod(shape)
        if name not in self._rooms or self._rooms[name].size < size or self._rooms[name].dtype != dtype:
            self._rooms[name] = np.empty(size, dtype)
        return self._rooms[name][:size].reshape(shape)

    def inputs(self) -> tuple[np.ndarray, np.ndarray]:
        """What each token adds to the gates, and the weights of the state; both as ``forward``
        takes them. sigmoid(a) is (1 + tanh(a / 2)) / 2; the halves are exact in the weights as well."""
        w, halved = self.w, np.ones(3 * self.h, self.w["wx"].dtype)
        halved[: 2 * self.h] = 0.5
        return (w["emb"] @ w["wx"] + w["b"]) * halved, w["wh"] * halved

    def forward(self, ids: np.ndarray, state: np.ndarray, inputs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Hidden states after each of the inputs ``ids`` (time, lane), from ``state`` on."""
        (gates, wh), h, (size, lanes) = inputs, self.h, ids.shape
        kind = gates.dtype
        half = np.array(0.5, kind)
        gx, gh, zr, n = (self._room(k, (lanes, d * h), kind) for k, d in (("gx_t", 3), ("gh_t", 3), ("zr_t", 2), ("n_t", 1)))
        gx_zr, gx_n, gh_zr, gh_n, z, r = gx[:, : 2 * h], gx[:, 2 * h :], gh[:, : 2 * h], gh[:, 2 * h :], zr[:, :h], zr[:, h:]
        add, mul, tanh, take = np.add, np.multiply, np.tanh, gates.take
        out, before = np.empty((size, lanes, h), kind), state.astype(kind, copy=False)
        for each, new in zip(ids, out):
            take(each, 0, gx, "clip")
            np.dot(before, wh, gh)
            add(gx_zr, gh_zr, zr)
            tanh(zr, zr)
            mul(zr, half, zr)
            add(zr, half, zr)
            mul(r, gh_n, n)
            add(n, gx_n, n)
            tanh(n, n)
            np.subtract(before, n, new)
            mul(new, z, new)
            add(new, n, new)
            before = new
        return out

    def steps(self, ids: np.ndarray, state: np.ndarray, keep: bool = False):
        """Hidden states after each of the inputs ``ids`` (time, lane), from ``state`` on. With
        ``keep`` also what ``backward`` needs and the embeddings, good until the next call; lanes
        are the last axis in it, so that with few of them each gate is one piece of memory."""
        if not keep:
            return self.forward(ids, state, self.inputs()), None, None
        w, h, (size, lanes) = self.w, self.h, ids.shape
        kind = w["wx"].dtype
        halved = np.ones(3 * h, kind)
        halved[: 2 * h] = half = np.array(0.5, kind)
        x = np.take(w["emb"], ids, axis=0, out=self._room("x", (size, lanes, self.e), kind), mode="clip")
        gx, wx, wh = self._room("gx", (size, 3 * h, lanes), kind), w["wx"] * halved, (w["wh"] * halved).T
        if lanes > 1:
            np.matmul(wx.T, x.transpose(0, 2, 1), out=gx)
        else:
            gx[..., 0] = x[:, 0] @ wx
        gx += (w["b"] * halved)[:, None]
        zrs, ns, ghs = (self._room(k, (size, d * h, lanes), kind) for k, d in (("zr", 2), ("n", 1), ("gh", 3)))
        states = self._room("states", (size + 1, h, lanes), kind)
        states[0] = state.T
        add, mul, tanh = np.add, np.multiply, np.tanh
        each = zip(gx[:, : 2 * h], gx[:, 2 * h :], ghs, ghs[:, : 2 * h], ghs[:, 2 * h :], zrs, zrs[:, :h], zrs[:, h:], ns, states, states[1:])
        for gx_zr, gx_n, gh, gh_zr, gh_n, zr, z, r, n, before, new in each:
            np.dot(wh, before, gh)
            add(gx_zr, gh_zr, zr)
            tanh(zr, zr)
            mul(zr, half, zr)
            add(zr, half, zr)
            mul(r, gh_n, n)
            add(n, gx_n, n)
            tanh(n, n)
            np.subtract(before, n, new)
            mul(new, z, new)
            add(new, n, new)
        out = np.empty((size, lanes, h), np.float32)
        out[...] = states[1:].transpose(0, 2, 1)
        return out, (states, zrs, ns, ghs), x

    def log_probs(self, hidden: np.ndarray, target: np.ndarray, gradient: bool = False):
        """Natural logarithms of P(target) for rows of hidden states. A tail class counts as its
        class only. With ``gradient`` also the gradients of the mean negative sum, good until the
        next call."""
        w, n, kind = self.w, len(target), np.result_type(hidden, self.w["wc"])
        word = target < self.n_words
        cls = np.where(word, target % self.c, self.c + target - self.n_words)
        wide = self.c + TAILS
        logits = np.matmul(hidden, w["wc"], out=self._room("p", (n, wide), kind))
        logits += w["bc"]

        def softmax(logits: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Log probabilities at ``picked`` (places in the flat array), and the sums of what
            ``logits`` then holds: their exp."""
            if logits.size and logits.max() > LARGEST:
                np.minimum(logits, LARGEST, out=logits)
            mine = logits.reshape(-1)[picked]
            sums = np.add.reduce(np.exp(logits, logits), 1, keepdims=True)
            return mine - np.log(sums[:, 0]), sums

        picked = np.arange(0, n * wide, wide) + cls
        out, total = softmax(logits, picked)
        p, g, dh = logits, {}, None
        if gradient:
            p /= total
            p.reshape(-1)[picked] -= 1
            p /= n
            dh = np.matmul(p, w["wc"].T, out=self._room("dh", (n, self.h), kind))
            g = {"wc": hidden.T @ p, "bc": np.add.reduce(p, 0), "ww": self._room("ww", w["ww"].shape, kind), "bw": np.zeros_like(w["bw"])}
        short = wide < 1 << 15  # sorts small numbers faster
        order = np.argsort(cls.astype(np.int16) if short else cls, kind="stable")  # words first, by class
        bounds = [0, *np.cumsum(np.bincount(cls, minlength=self.c)[: self.c]).tolist()]
        mine = order[: bounds[-1]]
        here, place = np.take(hidden, mine, axis=0), target[mine] // self.c + np.arange(0, len(mine) * self.s, self.s)
        spans = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]
        q = self._room("q", (len(mine), self.s), kind)
        ww, dot = w["ww"], np.dot
        for c, part in spans:
            dot(here[part], ww[c], q[part])
        q += np.take(w["bw"], cls[mine], axis=0, out=self._room("bias", q.shape, w["bw"].dtype), mode="clip")
        inner, sums = softmax(q, place)
        out[mine] += inner
        if gradient:
            g["ww"][np.diff(bounds) == 0] = 0
        if gradient and spans:
            q /= sums
            q.reshape(-1)[place] -= 1
            q /= n
            back = self._room("back", (len(mine) + 1, self.h), kind)
            back[-1] = 0  # for the tail classes
            there, across, gw, gb, sum_of = here.T, ww.transpose(0, 2, 1), g["ww"], g["bw"], np.add.reduce
            for c, part in spans:
                rows = q[part]
                dot(there[:, part], rows, gw[c])
                sum_of(rows, 0, None, gb[c])
                dot(rows, across[c], back[part])
            row_of = np.full(n, len(mine))
            row_of[mine] = np.arange(len(mine))
            dh += np.take(back, row_of, axis=0, out=self._room("inner", dh.shape, kind), mode="clip")
        return out, g, dh

    def backward(self, ids: np.ndarray, kept: tuple, x: np.ndarray, dh: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the recurrent part, from those of the hidden states (time, lane, hidden);
        nothing flows out of the window. Good until the next call."""
        w, h, (size, lanes) = self.w, self.h, ids.shape
        states, zrs, ns, ghs = kept
        kind, befores = ns.dtype, states[:-1]
        # What d (of the state) is multiplied by, once and twice, to give those of z and n.
        once, twice = (self._room(k, (size, 2, h, lanes), kind) for k in ("once", "twice"))
        shut = np.subtract(1, zrs, self._room("shut", zrs.shape, kind))
        np.subtract(befores, ns, once[:, 0])
        once[:, 1], twice[:, 0] = shut[:, :h], zrs[:, :h]
        np.multiply(ns, ns, twice[:, 1])
        np.subtract(1, twice[:, 1], twice[:, 1])
        above = self._room("above", (size, h, lanes), kind)
        above[...] = dh.transpose(0, 2, 1)
        # Gates z, r, n times r (as the state sees it), n (as the input sees it).
        gates, d, carry = self._room("gates", (size, 4, h, lanes), kind), self._room("d", (h, lanes), kind), self._room("carry", (h, lanes), kind)
        carry.fill(0)
        add, mul, dot, wh = np.add, np.multiply, np.dot, np.ascontiguousarray(w["wh"].T).T
        few = lanes < 38  # BLAS adds up small products in an order of its own, which lanes first keep
        back = [a[::-1] for a in (
            above, once, twice, zrs[:, :h], zrs[:, h:], shut[:, :h], shut[:, h:], ghs[:, 2 * h :],
            gates[:, ::3], gates[:, 0], gates[:, 1], gates[:, 2], gates[:, 3], gates[:, :3].reshape(size, 3 * h, lanes),
        )]
        for dh_t, one, two, z, r, shut_z, shut_r, ghn, dzn, dz, dr, dnr, dn, dgh in zip(*back):
            add(dh_t, carry, d)
            mul(one, d, dzn)
            mul(dzn, two, dzn)
            mul(dz, shut_z, dz)
            mul(dn, ghn, dr)
            mul(dr, r, dr)
            mul(dr, shut_r, dr)
            mul(dn, r, dnr)
            if few:
                carry[...] = dot(np.ascontiguousarray(dgh.T), w["wh"].T).T
            else:
                dot(wh, dgh, carry)
            mul(d, z, d)
            add(carry, d, carry)
        each = np.matmul(back[-1], befores[::-1].transpose(0, 2, 1), out=self._room("dwh", (size, 3 * h, h), kind))
        dgx = self._room("dgx", (size, lanes, 3, h), kind)
        dgx[:, :, :2] = gates[:, :2].transpose(0, 3, 1, 2)
        dgx[:, :, 2] = gates[:, 3].transpose(0, 2, 1)
        flat = dgx.reshape(-1, 3 * h)
        dx = np.matmul(flat, w["wx"].T, out=self._room("dx", (len(flat), self.e), kind))
        demb = self._room("demb", w["emb"].shape, kind)
        demb.fill(0)
        words = ids.reshape(-1)
        order = np.argsort(words.astype(np.int16) if len(demb) < 1 << 15 else words, kind="stable")
        words = words[order]
        starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        demb[words[starts]] = np.add.reduceat(np.take(dx, order, axis=0), starts, axis=0)
        return {"wx": x.reshape(-1, self.e).T @ flat, "b": np.add.reduce(flat, 0), "wh": np.ascontiguousarray(np.add.reduce(each, 0).T), "emb": demb}


class Trainer:
    """Adam on windows of documents that are read side by side; a lane carries the state of its
    document from window to window, and takes the next document when it ends."""

    def __init__(self, net: Gru, config: LmConfig, end: int):
        self.net, self.config, self.end, self.t, self.tokens = net, config, end, 0, 0
        net.w = {k: np.ascontiguousarray(v) for k, v in net.w.items()}  # updated in flat pieces
        self.m = {k: np.zeros_like(v) for k, v in net.w.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.w.items()}
        self.lanes: list[tuple[np.ndarray, int]] = []  # documents, the end before each, and how far they are read
        self.state = np.zeros((0, net.h), np.float32)
        self.share, self.new = np.float32(1), np.empty(CHUNK, np.float32)

    def read(self, document: np.ndarray) -> None:
        """Takes the token ids of a document; trains as long as no lane is free for the next."""
        self.lanes.append((np.concatenate([[self.end], document]).astype(np.int32), 0))
        self.state = np.concatenate([self.state, np.zeros((1, self.net.h), np.float32)])
        while len(self.lanes) >= self.config.lanes:
            self._window()

    def finish(self) -> None:
        """Trains on what is left of the documents taken."""
        while self.lanes:
            self._window()

    def _window(self) -> None:
        left = np.array([len(d) - 1 - at for d, at in self.lanes])
        size = min(self.config.window, int(left.max()))
        tokens = np.full((len(self.lanes), size + 1), self.end, np.int32)
        for row, (d, at) in zip(tokens, self.lanes):
            part = d[at : at + size + 1]
            row[: len(part)] = part
        inputs, targets = np.ascontiguousarray(tokens[:, :-1].T), tokens[:, 1:].T
        hidden, kept, x = self.net.steps(inputs, self.state, keep=True)
        flat = hidden.reshape(-1, self.net.h)
        if int(left.min()) < size:
            live = np.arange(size)[:, None] < left
            at, seen = np.flatnonzero(live), int(live.sum())
            _, g, dh = self.net.log_probs(np.take(flat, at, axis=0), targets[live], gradient=True)
            full = np.zeros_like(flat)
            full[at] = dh
        else:
            seen = inputs.size
            _, g, full = self.net.log_probs(flat, targets.reshape(-1), gradient=True)
        g |= self.net.backward(inputs, kept, x, full.reshape(hidden.shape))
        self.share = np.float32(seen / (self.config.lanes * self.config.window))  # each token weighs alike
        self._update(g)
        self.tokens += seen
        ahead = [(d, at + size) for d, at in self.lanes]
        stay = [j for j, (d, at) in enumerate(ahead) if at < len(d) - 1]
        self.lanes, self.state = [ahead[j] for j in stay], hidden[-1][stay]

    def _update(self, g: dict[str, np.ndarray]) -> None:
        """A step along ``share`` times the gradients, of a norm of at most 1."""
        self.t += 1
        share = self.share
        rough = math.sqrt(sum(float(np.dot(x.reshape(-1), x.reshape(-1))) for x in g.values())) * float(share)
        scale = np.float32(1)
        if not rough < 0.98:  # the norm counts
            for x in g.values():
                x *= share
            norm = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
            share, scale = scale, np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        rate = self.config.rate * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        factors = [np.array(x, np.float32) for x in (share, scale) if x != 1]
        # Arrays of no dimension are quicker factors than scalars.
        keep_m, add_m, keep_v, add_v, least, rate = (np.array(x, np.float32) for x in (0.9, 0.1, 0.99, 0.01, 1e-6, rate))
        add, mul = np.add, np.multiply
        for k, x in g.items():
            every = [a.reshape(-1) for a in (x, self.m[k], self.v[k], self.net.w[k])]
            for at in range(0, x.size, CHUNK):
                part, m, v, w = (a[at : at + CHUNK] for a in every)
                new = self.new[: len(part)]
                for factor in factors:
                    mul(part, factor, part)
                mul(m, keep_m, m)
                mul(part, add_m, new)
                add(m, new, m)
                mul(v, keep_v, v)
                mul(part, add_v, new)
                mul(new, part, new)
                add(v, new, v)
                np.sqrt(v, part)
                add(part, least, part)
                mul(m, rate, new)
                np.divide(new, part, new)
                np.subtract(w, new, w)


def log_likelihoods(net: Gru, documents: list[np.ndarray], end: int) -> np.ndarray:
    """Log10 probability of each list of token ids, the state carried from first to last token.
    Documents run side by side in blocks, longest first; memory holds one window of a block."""
    out = np.zeros(len(documents))
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    abreast, weights = min(net.config.block, ABREAST), net.inputs()
    for part in range(0, len(order), abreast):
        mine = order[part : part + abreast]
        size = np.array([len(documents[i]) for i in mine])
        flat = np.concatenate([documents[i] for i in mine])
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        state, total = np.zeros((len(mine), net.h), np.float32), np.zeros(len(mine))
        for at in range(0, int(size[0]), net.config.window):
            k = int(np.searchsorted(-size, -at, side="left"))  # documents that reach this window
            steps = min(net.config.window, int(size[0]) - at)
            time = at + np.arange(steps)[:, None]
            live = time < size[None, :k]
            place = np.minimum(begin[None, :k] + time, len(flat) - 1)
            target = flat[place]
            inputs = np.where(time > 0, flat[np.maximum(place - 1, 0)], end)
            hidden = net.forward(inputs, state[:k], weights)
            state = hidden[-1]
            here, target = np.flatnonzero(live), target[live]
            at_once = np.take(hidden.reshape(-1, net.h), here, axis=0)
            got = [net.log_probs(at_once[i : i + ROWS], target[i : i + ROWS])[0] for i in range(0, len(target), ROWS)]
            total[:k] += np.bincount(here % k, weights=np.concatenate(got), minlength=k)
        out[mine] = total / LOG10
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, c`` over all documents, the end included. Counts are combined in the tasks before
    the shuffle; a task's table is passed on when it has half a million words. Stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            words, _ = tokens_of(batch.column("text"))
            seen = pc.value_counts(words)
            held.append(pa.table({"word": seen.field(0), "c": seen.field(1)}))
            rows += len(seen)
            if rows > 1_000_000:
                held = [pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns({"c_sum": "c"})]
                rows = held[0].num_rows
                if rows > 500_000:
                    yield from held[0].select(["word", "c"]).to_batches()
                    held, rows = [], 0
        if held:
            full = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns({"c_sum": "c"})
            yield from full.select(["word", "c"]).to_batches()

    return stored(docs.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))


def vocabulary_of(counts: DataFrame, config: LmConfig) -> Vocabulary:
    """The bounded part of the counts that every task needs, with the totals over all of them."""
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("c"), "word").limit(config.known).toPandas()  # at most `known` rows
    words = [bytes(w) for w in top["word"]]
    known = dict(zip(words, (int(c) for c in top["c"])))
    ranked = words[: config.vocabulary]
    if END in known and END not in ranked:
        ranked[-1] = END
    ids = {w: i for i, w in enumerate(ranked)}

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(TAILS)
        for batch in batches:
            sums += np.bincount(tails_of(batch.column("word")), weights=batch.column("c").to_numpy() + config.smoothing, minlength=TAILS)
        yield pa.RecordBatch.from_pydict({"tail": np.arange(TAILS, dtype=np.int32), "mass": sums})

    found = counts.mapInArrow(shapes, "tail int, mass double").groupBy("tail").agg(F.sum("mass").alias("mass")).toPandas()
    mass = np.full(TAILS, config.smoothing)  # each tail class has room for an unseen word
    mass[found["tail"]] += found["mass"]
    for w in ids:
        mass[tail_of(w)] -= known[w] + config.smoothing
    n, v = int(total[0] or 0), int(total[1])
    return Vocabulary(ids, known, n, v, np.maximum(mass, config.smoothing) / (n + config.smoothing * (v + 1)), config.smoothing)


def ids_of(words: pa.Array, vocabulary: Vocabulary) -> np.ndarray:
    """Token ids: a word of the network or its tail class."""
    out = numbers_of(words, pa.array(vocabulary.ids, pa.binary())).copy()
    rare = out < 0
    out[rare] = len(vocabulary.ids) + tails_of(words.filter(pa.array(rare)))
    return out


def _ids(words: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    """The same for a list of words."""
    return ids_of(pa.array(words, pa.binary()), vocabulary)


def train(docs: DataFrame, vocabulary: Vocabulary, config: LmConfig = LmConfig()) -> dict[str, np.ndarray]:
    """Weights after ``rounds`` rounds. In each one every task of the scan trains on all
    tokens of all of its documents, and the results are averaged by tokens, in two steps, so that neither a
    task nor the driver holds more than a few copies of the network."""
    start = Gru(vocabulary, config)
    end = vocabulary.ids.get(END, len(vocabulary.ids) + tail_of(END))
    rows = docs.select("text", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID)), F.lit(config.seed)), F.lit(1 << 40)).alias("mix"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    weights = start.w
    for _ in range(config.rounds):
        state = docs.sparkSession.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = shared.value
            net = Gru(words, config, {k: v.copy() for k, v in state.value.items()})
            trainer, first = Trainer(net, config, end), None
            for batch in batches:
                if not batch.num_rows:
                    continue
                first = batch.column("mix")[0].as_py() if first is None else first
                tokens, bounds = tokens_of(batch.column("text"))
                for document in np.split(ids_of(tokens, words), bounds[1:-1]):
                    trainer.read(document)
            trainer.finish()
            if trainer.tokens:
                yield pa.RecordBatch.from_pydict({"part": [first % 64], "tokens": [trainer.tokens], "weights": [net.pack()]})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """The mean of the weights, by tokens."""
            total, tokens = None, 0
            for batch in batches:
                for n, w in zip(batch["tokens"], batch["weights"]):
                    part = np.frombuffer(w, np.float32).astype(np.float64) * n
                    total, tokens = part if total is None else total + part, tokens + int(n)
            if tokens:
                yield pd.DataFrame({"tokens": [tokens], "weights": [(total / tokens).astype(np.float32).tobytes()]})

        trained = rows.mapInArrow(run, "part long, tokens long, weights binary")
        parts = trained.repartition(16, "part").mapInPandas(add, "tokens long, weights binary")  # at most 64 rows
        row = parts.repartition(1).mapInPandas(add, "tokens long, weights binary").first()
        if row is None:
            break
        weights = start.unpack(np.frombuffer(row.weights, np.float32))
    return weights


def score_documents(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, weights: dict[str, np.ndarray], config: LmConfig = LmConfig()) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    A task scores its documents with the network and the known words; the words it does not know
    leave it as (word, times) and meet their counts in a join on the word. Rows alike in id and
    text give equal results. A null or empty text is the end alone.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, weights))
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("id")
    rows = docs.select(key, F.xxhash64(text_of()).alias("th"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, w = shared.value
        net = Gru(words, config, w)
        end = words.ids.get(END, len(words.ids) + tail_of(END))
        log_mass = np.log10(words.mass)
        # Known words by number, those of the network first: one lookup a token gives the rest.
        names = pa.array([*words.ids, *(w for w in words.counts if w not in words.ids)], pa.binary())
        log_base = np.log10(words.base(np.array([words.counts[w] for w in names.to_pylist()], float)))
        net_id = np.concatenate([np.arange(net.n_words), net.n_words + tails_of(names[net.n_words :])]).astype(np.int32)
        held: list[pa.Table] = []
        waiting: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            out = pa.concat_tables(held)
            net_part = out["net"].to_numpy() + log_likelihoods(net, waiting, end)
            yield from out.set_column(out.column_names.index("net"), "net", pa.array(net_part)).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, bounds = tokens_of(batch.column("text"))
            numbers = numbers_of(tokens, names)
            unknown = numbers < 0
            strange = tokens.filter(pa.array(unknown))
            ids = np.empty(len(tokens), np.int32)
            ids[~unknown] = net_id[numbers[~unknown]]
            ids[unknown] = net.n_words + tails_of(strange)
            documents, sums = np.split(ids, bounds[1:-1]), []
            for mine, i in zip(np.split(numbers, bounds[1:-1]), documents):
                known = mine[mine >= 0]
                inside = log_base[known[known >= net.n_words]].sum()
                sums.append((len(mine), len(known), log_base[known].sum(), inside - log_mass[i[i >= net.n_words] - net.n_words].sum()))
            # The unknown words of each document, each once.
            text = np.repeat(np.arange(batch.num_rows), np.diff(bounds))[unknown]
            rare = pa.table({"text": text, "word": strange}).group_by(["text", "word"]).aggregate([([], "count_all")]).sort_by("text").combine_chunks()
            begin = np.searchsorted(rare["text"].to_numpy(), np.arange(batch.num_rows + 1)).astype(np.int32)
            each = pa.StructArray.from_arrays([rare[k].combine_chunks() for k in ("word", "count_all")], ["word", "n"])
            made = dict(zip(("n_tokens", "known", "base", "net"), zip(*sums)))
            held.append(pa.table({"id": batch.column("id"), "th": batch.column("th"), **made, "rare": pa.ListArray.from_arrays(pa.array(begin), each)}))
            waiting += documents
            size += len(ids)
            if size >= config.held_tokens:
                yield from flush()
                held, waiting, size = [], [], 0
        if held:
            yield from flush()

    schema = "id long, th long, n_tokens long, known long, base double, net double, rare array<struct<word: binary, n: bigint>>"
    scored = stored(rows.mapInArrow(run, schema))
    rare = one_per_key(scored.select("id", "th", "rare"), ["id", "th"]).select("id", "th", F.explode("rare").alias("r"))
    met = rare.select("id", "th", F.col("r.word").alias("word"), F.col("r.n").alias("n")).join(counts, "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    share = F.log10((c + config.smoothing) / F.lit(vocabulary.total + config.smoothing * (vocabulary.distinct + 1)))
    sums = met.groupBy("id", "th").agg(
        F.sum(F.col("n") * share).alias("rest"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rest_known")
    )
    full = scored.drop("rare").join(sums, ["id", "th"], "left")
    rest, doc_id = F.coalesce("rest", F.lit(0.0)), F.when(F.col("id") != NO_ID, F.col("id"))
    return full.select(
        doc_id.alias("doc_id"), held_out(doc_id, config.folds).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("bigint").alias("train_tokens"), (F.col("base") + rest).alias("base_score"), (F.col("net") + rest).alias("score"),
    )


def score_corpus(docs: DataFrame, config: LmConfig = LmConfig()) -> DataFrame:
    """Count, train and score: learns from the documents outside the held-out fold (a null id is
    outside), scores all. Without training documents every word is unseen."""
    learn = docs.filter(~held_out(F.col("doc_id"), config.folds)).select("doc_id", text_of().alias("text"))
    counts = word_counts(learn)
    vocabulary = vocabulary_of(counts, config)
    return score_documents(docs, counts, vocabulary, train(learn, vocabulary, config), config)


def op4_gru_lm(spark, sf_dir: str) -> DataFrame:
    bounded_batches(spark, 8)
    return score_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_gru_lm": op4_gru_lm}
ORACLES: dict[str, str] = {}
