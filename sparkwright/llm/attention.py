"""A small causal self-attention language model in numpy.

Inputs are subword ids; the output is a class of ids, and within a class the ids' share of the
training corpus after the id before. Frequent ids are classes of their own, the others fall into
classes by frequency. For each id before, the shares of a class sum to one, so scores are those of a
distribution over ids.
One head attends over a window; windows overlap, and each id is scored in one window only, with at
least `overlap` ids before it (or all there are).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

LENGTH = 32
OVERLAP = 8
DIM = 16
HIDDEN = 32
SINGLE = 96
TAIL = 32
INPUTS = 2048
STATES = 512
ROWS = 512  # that pass the last layers together, so that what lies between them stays in the processor's cache
_MASK = np.tril(np.ones((LENGTH, LENGTH), np.float32))
_ONES = np.ones(max(LENGTH, ROWS), np.float32)


@dataclass
class Vocabulary:
    """Of ids: the class, log10 of the share within it, and the place by frequency. Beside that, for the more
    frequent ids, a table of the log10 shares within the class after each of the most frequent ids before."""

    classes: np.ndarray
    inside: np.ndarray
    place: np.ndarray
    n_classes: int
    after: np.ndarray | None = None
    rows: np.ndarray | None = None
    columns: np.ndarray | None = None

    @staticmethod
    def of(counts: np.ndarray, single: int = SINGLE, tail: int = TAIL) -> Vocabulary:
        """counts: of each id in the training corpus; one is added to each, so none is impossible."""
        order = np.lexsort((np.arange(len(counts)), -counts))
        place = np.empty(len(counts), np.int64)
        place[order] = np.arange(len(counts))
        # tail classes of about equal share, as the counts run out
        mass = np.cumsum((counts[order] + 1.0)[single:])
        group = np.minimum((mass / mass[-1] * tail).astype(np.int64), tail - 1) if len(mass) else np.zeros(0, np.int64)
        group = np.concatenate([np.arange(min(single, len(counts))), single + group])
        _, group = np.unique(group, return_inverse=True)
        classes = group[place]
        share = counts + 1.0
        inside = np.log10(share / np.bincount(classes, share)[classes])
        return Vocabulary(classes, inside, place, int(classes.max()) + 1)

    def pair(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Cells of the table: STATES rows by what stands before, INPUTS columns by the id (below 0 for rarer ones)."""
        if self.rows is None:
            self.rows = (np.minimum(self.place, STATES - 1) * INPUTS).astype(np.int32)
            self.columns = np.where(self.place < INPUTS, self.place, -STATES * INPUTS).astype(np.int32)
        return self.rows[before] + self.columns[ids]

    def learn_pairs(self, counts: np.ndarray, prior: float = 20.0) -> None:
        """counts of the table's cells in the training corpus; the share without regard to what stands before weighs `prior` ids."""
        counts = counts.reshape(STATES, INPUTS).astype(float)
        columns = min(INPUTS, len(self.place))
        own = np.argsort(self.place)[:columns]
        classes, share = self.classes[own], 10 ** self.inside[own]
        rare = np.bincount(classes, share, minlength=self.n_classes)  # of a class, what the table's columns hold
        after = np.zeros((STATES, INPUTS), np.float32)
        for s in range(STATES):
            n = counts[s, :columns]
            total = np.bincount(classes, n, minlength=self.n_classes)
            # rarer ids of the class keep their share, so that a class sums to one
            after[s, :columns] = np.log10((n + prior * share) / (total + prior * rare)[classes] * rare[classes])
        self.after = after.ravel()

    def within(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10 of the share of each id in its class, after the id before it."""
        if self.after is None:
            return self.inside[ids]
        cell = self.pair(before, ids)
        return np.where(cell >= 0, self.after[cell], self.inside[ids])


def windows(n: int, length: int = LENGTH, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """Of n positions: where windows start, and the first place that each one scores. Each position is scored once."""
    step = length - overlap
    firsts = np.concatenate([[0], np.arange(length, n, step)]) if n > length else np.zeros(1, np.int64)
    starts = np.maximum(firsts - overlap, 0)
    return starts, firsts - starts


class Model:
    """Weights by name; forward and backward over batches of whole windows."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.vocabulary = vocabulary
        self.w = {
            "E": 0.3 * rng.standard_normal((INPUTS, DIM)).astype(np.float32), "P": 0.1 * rng.standard_normal((LENGTH, DIM)).astype(np.float32),
            "Q": init(DIM, 3 * DIM), "O": 0.3 * init(DIM, DIM), "A": init(DIM, HIDDEN), "a": np.zeros(HIDDEN, np.float32),
            "B": 0.3 * init(HIDDEN, DIM), "C": init(DIM, vocabulary.n_classes), "c": np.zeros(vocabulary.n_classes, np.float32),
        }

    def body(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        """Up to the last hidden layer: inputs (n, LENGTH). h is the head's output, inverse that of the sum of its weights e."""
        w, n = self.w, len(inputs)
        x = w["E"][inputs]
        x += w["P"]
        scaled = w["Q"].copy()
        scaled[:, :DIM] *= np.float32(DIM**-0.5)
        qkv = (x.reshape(-1, DIM) @ scaled).reshape(n, LENGTH, 3 * DIM)
        across = np.empty((n, 2 * DIM + 1, LENGTH), np.float32)  # keys, values and ones, each a row over the window
        across[:, : 2 * DIM] = qkv[:, :, DIM:].transpose(0, 2, 1)
        across[:, 2 * DIM] = 1
        e = np.matmul(qkv[:, :, :DIM], across[:, :DIM])
        if e.max(initial=0) > 80:  # near the limit of single precision; only weights gone astray lead there
            e -= e.max(2, keepdims=True)
        np.exp(e, out=e)
        e *= _MASK
        inverse = 1 / (e.reshape(-1, LENGTH) @ _ONES[:LENGTH])[:, None]
        h = np.matmul(e, qkv[:, :, 2 * DIM :]).reshape(-1, DIM)
        h *= inverse
        y = h @ w["O"]
        y += x.reshape(-1, DIM)
        return {"x": x.reshape(-1, DIM), "scaled": scaled, "qkv": qkv, "across": across, "e": e, "h": h, "y": y, "inverse": inverse}

    def head(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of hidden rows (m, DIM): the logits of classes without their bias, and what leads to them."""
        w = self.w
        z = y @ w["A"]
        z += w["a"]
        np.maximum(z, 0, out=z)
        y2 = z @ w["B"]
        y2 += y
        p = y2 @ w["C"]
        if p.max(initial=0) > 60:  # as in body(); a row may be shifted
            p -= p.max(1, keepdims=True)
        return p, z, y2

    def gradients(self, inputs: np.ndarray, classes: np.ndarray, weight: np.ndarray, with_loss: bool = True) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the positions that count (0 if not asked for), and its gradient by each weight.

        The classes' bias weighs sums and products of the exponents instead of the exponents themselves, and
        so do the rows' sums: only one pass over them is made beside the exponents' own.
        """
        w, n = self.w, len(inputs)
        s = self.body(inputs)
        y = s["y"]
        target, count = classes.ravel(), (weight.ravel() / max(1.0, float(weight.sum()))).astype(np.float32)
        bias = w["c"] - w["c"].max()
        share = np.exp(bias)
        weighted = np.ascontiguousarray((w["C"] * share).T)
        dy, out = np.empty_like(y), np.zeros((DIM + 1, len(share)), np.float32)
        g = {"B": np.zeros_like(w["B"]), "A": np.zeros_like(w["A"]), "a": np.zeros_like(w["a"])}
        loss = 0.0
        for at in range(0, len(y), ROWS):
            own, t, c = y[at : at + ROWS], target[at : at + ROWS], count[at : at + ROWS]
            p, z, y2 = self.head(own)
            rows = np.arange(len(p))
            hit = p[rows, t] + bias[t] if with_loss else None
            np.exp(p, out=p)
            total = p @ share
            if with_loss:
                loss += float(((np.log(total) - hit) * c).sum())
            p[rows, t] -= total / share[t]
            c = (c / total)[:, None]
            out += np.concatenate([y2 * c, c], 1).T @ p
            d = p @ weighted
            d *= c
            g["B"] += z.T @ d
            dz = d @ w["B"].T
            dz *= z > 0
            g["A"] += own.T @ dz
            g["a"] += _ONES[: len(dz)] @ dz
            d += dz @ w["A"].T
            dy[at : at + ROWS] = d
        out *= share
        g["C"], g["c"] = out[:DIM], out[DIM]
        g["O"] = s["h"].T @ dy
        # what each place passes back, over the sum of its weights; the last column takes off its mean by these weights
        dh = np.empty((len(y), DIM + 1), np.float32)
        np.multiply(dy @ w["O"].T, s["inverse"], out=dh[:, :DIM])
        np.negative(np.einsum("ij,ij->i", dh[:, :DIM], s["h"]), out=dh[:, DIM])
        dh = dh.reshape(n, LENGTH, DIM + 1)
        e, qkv = s["e"], s["qkv"]
        ds = np.matmul(dh, s["across"][:, DIM:])
        ds *= e
        dqkv = np.empty((n, LENGTH, 3 * DIM), np.float32)
        np.matmul(ds, qkv[:, :, DIM : 2 * DIM], out=dqkv[:, :, :DIM])
        np.matmul(ds.transpose(0, 2, 1), qkv[:, :, :DIM], out=dqkv[:, :, DIM : 2 * DIM])
        np.matmul(e.transpose(0, 2, 1), dh[:, :, :DIM], out=dqkv[:, :, 2 * DIM :])
        dqkv = dqkv.reshape(-1, 3 * DIM)
        g["Q"] = s["x"].T @ dqkv
        g["Q"][:, :DIM] *= np.float32(DIM**-0.5)
        dy += dqkv @ s["scaled"].T
        g["P"] = dy.reshape(n, LENGTH, DIM).sum(0)
        order = np.argsort(inputs.astype(np.uint16), axis=None, kind="stable")  # numpy sorts 16 bits by radix
        ids = inputs.ravel()[order]
        starts = np.concatenate([[0], np.nonzero(ids[1:] != ids[:-1])[0] + 1])
        g["E"] = np.zeros_like(w["E"])
        g["E"][ids[starts]] = np.add.reduceat(dy[order], starts)
        return loss, g

    def log10(self, texts: list[np.ndarray], start: int, batch: int = 64) -> np.ndarray:
        """log10 probability of each text's ids. Windows of all texts go through in batches."""
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum():
            return np.zeros(len(texts))
        ids = np.concatenate(texts)
        offset = np.cumsum(sizes) - sizes
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[offset[sizes > 0]] = start
        inputs = np.minimum(self.vocabulary.place, INPUTS - 1)[before]
        classes = self.vocabulary.classes[ids]
        cuts = [windows(n) for n in sizes.tolist() if n]
        own = np.repeat(np.nonzero(sizes)[0], [len(s) for s, _ in cuts])
        starts = np.concatenate([s for s, _ in cuts])
        first = np.concatenate([f for _, f in cuts])[:, None]
        left = (sizes[own] - starts)[:, None]
        starts = (starts + offset[own])[:, None]
        place = np.arange(LENGTH)
        bias = self.w["c"] - self.w["c"].max()
        share = np.exp(bias)
        each, at = np.empty(len(ids)), 0
        for k in range(0, len(own), batch):
            f, rest = first[k : k + batch], left[k : k + batch]
            y = self.body(inputs[starts[k : k + batch] + np.minimum(place, rest - 1)])["y"]
            # windows score the ids in their order, each one once
            y = y[((place >= f) & (place < rest)).ravel()]
            for r in range(0, len(y), ROWS):
                p, _, _ = self.head(y[r : r + ROWS])
                t = classes[at : at + len(p)]
                hit = p[np.arange(len(p)), t] + bias[t]
                np.exp(p, out=p)
                each[at : at + len(p)] = hit - np.log(p @ share)
                at += len(p)
        each /= np.log(10)
        each += self.vocabulary.within(before, ids)
        return np.bincount(np.repeat(np.arange(len(texts)), sizes), each, minlength=len(texts))


class Adam:
    """Running means of a model's gradients and their squares; steps of a given rate. All weights lie in one vector, of which the model's are parts."""

    def __init__(self, model: Model):
        self.model, self.step, at = model, 0, 0
        self.flat = np.concatenate([x.ravel() for x in model.w.values()])
        for k, x in list(model.w.items()):
            model.w[k] = self.flat[at : at + x.size].reshape(x.shape)
            at += x.size
        self.m, self.v, self.g, self.t = (np.zeros_like(self.flat) for _ in range(4))

    def take(self, inputs: np.ndarray, classes: np.ndarray, weight: np.ndarray, rate: float) -> None:
        self.step += 1
        _, found = self.model.gradients(inputs, classes, weight, False)
        m, v, g, t = self.m, self.v, self.g, self.t
        np.concatenate([found[k].ravel() for k in self.model.w], out=g)
        np.multiply(g, g, out=t)
        g -= m
        g *= np.float32(0.1)
        m += g
        t -= v
        t *= np.float32(0.01)
        v += t
        np.multiply(v, np.float32(1 / (1 - 0.99**self.step)), out=t)
        np.sqrt(t, out=t)
        t += np.float32(1e-7)
        np.divide(m, t, out=t)
        t *= np.float32(rate / (1 - 0.9**self.step))
        self.flat -= t


def examples(vocabulary: Vocabulary, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, classes and weights of pieces of 2 to LENGTH + 1 ids."""
    ids = np.zeros((len(texts), LENGTH + 1), np.int64)
    for i, t in enumerate(texts):
        t = t[: LENGTH + 1]
        ids[i, : len(t)] = t
    sizes = np.array([min(len(t), LENGTH + 1) for t in texts])
    weight = (np.arange(LENGTH) < sizes[:, None] - 1).astype(np.float32)
    return np.minimum(vocabulary.place[ids[:, :-1]], INPUTS - 1), vocabulary.classes[ids[:, 1:]], weight


def go_on(model: Model, batches: Iterable[list[np.ndarray]], rate: float) -> int:
    """Trains the model further, one step for each batch of pieces; returns how many pieces there were."""
    adam, seen = Adam(model), 0
    for pieces in batches:
        adam.take(*examples(model.vocabulary, pieces), rate * min(1.0, (adam.step + 1) / 50))
        seen += len(pieces)
    return seen


def train(vocabulary: Vocabulary, texts: list[np.ndarray], steps: int = 2500, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Model:
    """Fits a model to pieces of texts (LENGTH ids each, or fewer at an end) by Adam. Deterministic. Without pieces the classes are equally likely."""
    model = Model(vocabulary, seed)
    texts = [t for t in texts if len(t) > 1]
    if not texts:
        model.w["C"][:] = 0
        return model
    inputs, classes, weight = examples(vocabulary, texts)
    share = np.bincount(classes[weight > 0], minlength=vocabulary.n_classes) + 0.5
    model.w["c"] = np.log(share / share.sum()).astype(np.float32)
    model.w["C"] *= 0.1
    rng = np.random.default_rng(seed)
    adam = Adam(model)
    order = rng.permutation(len(texts))
    at = 0
    for step in range(1, steps + 1):
        if at + batch > len(order):
            order, at = rng.permutation(len(texts)), 0
        own = order[at : at + batch]
        at += batch
        adam.take(inputs[own], classes[own], weight[own], rate * min(1.0, step / 50) * (0.5 + 0.5 * np.cos(np.pi * step / steps)) + 1e-5)
    return model
