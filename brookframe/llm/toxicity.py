"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A word's input is an embedding of its hash plus the mean of those of its character n-grams. A window of words goes
through one recurrent layer in each direction; attention pools the states, and a logistic output scores the window.
A document's score is that of its worst window, calibrated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import in_fold, labelled_texts
from .scratch import lean
from .words import LOWER, mix, split_words, text_slices, word_hashes


@dataclass(frozen=True)
class Toxicity:
    """fit_rows labelled documents of at most fit_chars characters fit the model, by at most `places` windows of toxic documents in a round."""

    fit_rows: int = 3000
    fit_chars: int = 20_000
    folds: int = 4
    held_out: int = 2
    threshold: float = 0.3
    window: int = 16
    stride: int = 1
    vocabulary: int = 20_000  # words, and as many n-grams, of the fitting sample: those in most documents
    least_documents: int = 3  # others have no embedding, as those that are never seen
    gram: int = 4  # bytes
    dim: int = 12
    hidden: int = 8
    rounds: int = 3  # of choosing the windows that stand for a toxic document
    epochs: int = 3  # in each round, or as many as make `steps` updates
    steps: int = 200
    negatives: int = 8  # windows of a clean document, in each round
    places: int = 18_000
    rate: float = 0.01
    seed: int = 9


_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Words:
    """Distinct words of a run of texts, the type of each word, and each text's first word."""

    types: np.ndarray
    first: np.ndarray
    bucket: np.ndarray  # of each type its hash, or its number in a vocabulary
    grams: np.ndarray  # of all types in turn, likewise
    gram_first: np.ndarray


def read_words(buf: np.ndarray, offs: np.ndarray, p: Toxicity) -> Words:
    """Words without the punctuation around them, in lower case; n-grams of p.gram bytes with the word's ends marked."""
    starts, ends, first = split_words(buf, offs)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return Words(z, first, z, z, np.zeros(1, np.int64))
    # the first and last letter of each word; a word without any stays whole
    letter = _LETTER[buf]
    letters, before = np.r_[np.flatnonzero(letter), 0], np.zeros(len(buf) + 1, np.int64)
    np.cumsum(letter, out=before[1:])
    some = before[ends] > before[starts]
    a, b = np.where(some, letters[before[starts]], starts), np.where(some, letters[before[ends] - 1] + 1, ends)
    low = LOWER[buf]
    hashes, shown, types = np.unique(word_hashes(low, a, b), return_index=True, return_inverse=True)
    a, b = a[shown], b[shown]
    # the letters of all types, one after another, each with a mark before and after
    size = b - a + 2
    begin = np.r_[0, np.cumsum(size)]
    place = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
    source = np.clip(np.repeat(a, size) + place - 1, 0, len(buf) - 1)
    text = low[source].astype(np.uint64)
    text[(place == 0) | (place == np.repeat(size, size) - 1)] = 1
    room = np.repeat(begin[1:], size) - np.arange(begin[-1])
    code = np.zeros(len(text), np.uint64)
    for i in range(p.gram):
        code *= np.uint64(257)
        code[: len(code) - i] += text[i:]
    # a word shorter than an n-gram has none
    fits = np.flatnonzero(room >= p.gram)
    return Words(types, first, hashes, mix(code[fits]), np.searchsorted(fits, begin))


def window_starts(first: np.ndarray, p: Toxicity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first word of each window, its text, and each text's first window.

    Windows start every p.stride words until one reaches the end of the text; a text without words has one empty window.
    """
    n = np.diff(first)
    count = np.maximum(1, -(-(n - p.window) // p.stride) + 1)
    text = np.repeat(np.arange(len(n)), count)
    own = np.r_[0, np.cumsum(count)]
    return first[:-1][text] + (np.arange(own[-1]) - own[:-1][text]) * p.stride, text, own


def window_words(start: np.ndarray, end: np.ndarray, p: Toxicity) -> np.ndarray:
    """Word numbers of windows (n x window), -1 beyond the end of the text."""
    words = start[:, None] + np.arange(p.window)
    words[words >= end[:, None]] = -1
    return words


def windows_of(first: np.ndarray, p: Toxicity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts: word numbers, the text of each, and each text's first window."""
    start, text, own = window_starts(first, p)
    return window_words(start, first[1:][text], p), text, own


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _number(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.zeros(len(hashes), np.int64)
    if len(hashes) < 1 << 16:
        at = np.searchsorted(vocabulary, hashes)
        return np.where(vocabulary[np.minimum(at, len(vocabulary) - 1)] == hashes, at, len(vocabulary))
    # a few hashes begin with the same 16 bits
    top = np.uint64(48)
    begin = np.searchsorted(vocabulary >> top, np.arange((1 << 16) + 1, dtype=np.uint64))
    at, out = begin[hashes >> top], np.full(len(hashes), len(vocabulary))
    for _ in range(int(np.diff(begin).max())):
        np.minimum(at, len(vocabulary) - 1, out=at)
        same = vocabulary[at] == hashes
        out[same] = at[same]
        at += 1
    return out


def _vocabulary(each: list[np.ndarray], p: Toxicity) -> np.ndarray:
    """Sorted hashes that p.least_documents documents or more have, the p.vocabulary most frequent of them. each: a document's distinct hashes."""
    value, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *each]), return_counts=True)
    keep = np.argsort(-count, kind="stable")[: p.vocabulary]
    return np.sort(value[keep[count[keep] >= p.least_documents]])


def _grams_of(words: Words, types: np.ndarray) -> np.ndarray:
    """The n-grams of some types, in turn."""
    n = np.diff(words.gram_first)[types]
    begin = np.r_[0, np.cumsum(n)]
    return words.grams[np.repeat(words.gram_first[:-1][types] - begin[:-1], n) + np.arange(begin[-1])]


def _joined(parts: list[Words]) -> Words:
    """Words of several runs of texts as one run; a type may then occur once for each."""
    shift = lambda name: np.cumsum([0, *(len(getattr(w, name)) for w in parts)]).tolist()
    types = np.concatenate([w.types + i for w, i in zip(parts, shift("bucket"), strict=False)])
    ends = [np.r_[w.first[1:]] + i for w, i in zip(parts, shift("types"), strict=False)]
    grams = [w.gram_first[1:] + i for w, i in zip(parts, shift("grams"), strict=False)]
    return Words(types, np.r_[0, np.concatenate(ends)], np.concatenate([w.bucket for w in parts]), np.concatenate([w.grams for w in parts]), np.r_[0, np.concatenate(grams)])


class Network:
    """Parameters by name, forward and backward passes."""

    def __init__(self, p: Toxicity, words: np.ndarray, grams: np.ndarray):
        """words, grams: sorted hashes of the vocabularies; the last row of an embedding is for all others, and zero."""
        self.words, self.grams = words, grams
        rng, d, h = np.random.default_rng(p.seed), p.dim, p.hidden
        make = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
        self.p = p
        self.w = {"word": np.zeros((len(words) + 1, d), np.float32), "gram": np.zeros((len(grams) + 1, d), np.float32), "a": make(2 * h, h), "a0": np.zeros(h, np.float32), "v": make(h), "o": make(2 * h), "c": np.zeros((), np.float32)}
        self.w["word"][:-1] = 0.05 * rng.normal(size=(len(words), d))
        self.w["gram"][:-1] = 0.05 * rng.normal(size=(len(grams), d))
        for side in "fb":
            self.w |= {f"x{side}": make(d, 3 * h), f"u{side}": make(h, 3 * h), f"b{side}": np.zeros(3 * h, np.float32)}

    def known(self, words: Words) -> Words:
        """The same with numbers in the vocabularies for hashes."""
        return replace(words, bucket=_number(words.bucket, self.words), grams=_number(words.grams, self.grams))

    def inputs(self, words: Words) -> np.ndarray:
        """One input for each type."""
        n = np.diff(words.gram_first)
        out = self.w["word"][words.bucket]
        # the i-th n-grams of all words that have so many; of very long words one after another
        begin, few = words.gram_first[:-1], np.where(n > 32, 0, n)
        order = np.argsort(-few, kind="stable")
        at, sums = begin[order], np.zeros_like(out)
        for i, k in enumerate(np.searchsorted(-few[order], -np.arange(1, 33), "right").tolist()):
            sums[:k] += self.w["gram"].take(words.grams[at[:k] + i], axis=0)
        out[order] += sums / np.maximum(n[order], 1)[:, None].astype(np.float32)
        for i in np.flatnonzero(n > 32).tolist():
            out[i] += self.w["gram"][words.grams[begin[i] : begin[i] + n[i]]].mean(axis=0)
        return out

    def _layer(self, side: str, projected: np.ndarray, rows: np.ndarray, mask: np.ndarray, keep: bool):
        """States of one direction, time first. projected: the inputs times x and plus b, a row for each type."""
        u, h = self.w[f"u{side}"], self.p.hidden
        n, steps = rows.shape
        state, states, saved = np.zeros((n, h), np.float32), np.empty((steps, n, h), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            x, hu = projected[rows[:, t]], state @ u
            gates = x[:, : 2 * h] + hu[:, : 2 * h]
            np.negative(gates, out=gates)
            np.exp(np.minimum(gates, 30, out=gates), out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * hu[:, 2 * h :])
            before = state
            state = before + mask[:, t, None] * (1 - z) * (new - before)
            states[t] = state
            if keep:
                saved.append((t, before, z, r, new, hu[:, 2 * h :]))
        return states, saved

    def _layer_back(self, side: str, saved, mask: np.ndarray, d_states: np.ndarray, grads: dict) -> np.ndarray:
        u, h = self.w[f"u{side}"], self.p.hidden
        d_x, carry = np.zeros((len(mask), mask.shape[1], 3 * h), np.float32), np.zeros((len(mask), h), np.float32)
        for t, before, z, r, new, hn in reversed(saved):
            d = d_states[t] + carry
            m = mask[:, t, None]
            d_new = d * m * (1 - z) * (1 - new**2)
            d_z = -d * m * (new - before) * z * (1 - z)
            d_r = d_new * hn * r * (1 - r)
            d_x[:, t] = np.concatenate([d_z, d_r, d_new], axis=1)
            through = np.concatenate([d_z, d_r, d_new * r], axis=1)
            grads[f"u{side}"] += before.T @ through
            carry = d * (1 - m * (1 - z)) + through @ u.T
        return d_x

    def project(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        return {side: inputs @ self.w[f"x{side}"] + self.w[f"b{side}"] for side in "fb"}

    def forward(self, projected: dict[str, np.ndarray], rows: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. rows: for each place of a window the row of its type; mask: 0 beyond the text."""
        sides = {side: self._layer(side, projected[side], rows, mask, keep) for side in "fb"}
        both = np.concatenate([sides["f"][0], sides["b"][0]], axis=2)
        hidden = np.tanh(both @ self.w["a"] + self.w["a0"])
        energy = np.where(mask.T > 0, hidden @ self.w["v"], np.float32(-1e9))
        weight = np.exp(energy - energy.max(axis=0)) * mask.T
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", weight, both)
        return pooled @ self.w["o"] + self.w["c"], (sides, both, hidden, weight, pooled)

    def logits(self, words: Words, start: np.ndarray, end: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
        """Of windows given by their first words and the ends of their texts.

        text: of each window its text, in order; then windows of which a bound shows that another of their text is greater may get -inf.
        """
        inputs = np.r_[self.inputs(words), np.zeros((1, self.p.dim), np.float32)]
        types, out = np.r_[words.types, len(words.bucket)], np.full(len(start), -np.inf, np.float32)
        whole = start + self.p.window <= end
        if whole.any():
            owner = None
            if text is not None:
                owner = np.full(len(words.types), -1)
                owner[start[whole]] = text[whole]
            out[whole] = self._whole(inputs, words.types, owner)[start[whole]]
        short = np.flatnonzero(~whole)
        projected = self.project(inputs) if len(short) else {}
        for i in range(0, len(short), 2048):
            at = window_words(start[short[i : i + 2048]], end[short[i : i + 2048]], self.p)
            out[short[i : i + 2048]] = self.forward(projected, types[at], (at >= 0).astype(np.float32))[0]
        return out

    def _whole(self, inputs: np.ndarray, types: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
        """forward() of the window of p.window words at each word: neighbours are slices of one array, words last.

        owner: the text of the window at each word, -1 for none. All states of all windows are computed. A logit is a mean of the
        window's outputs o @ state, so it is not above the greatest of them: attention is left out where that is below a
        logit of the same text, and for windows of no text.
        """
        h, steps, w, size = self.p.hidden, self.p.window, self.w, 4096
        count = len(types) - steps + 1
        # gates are 1 / (1 + exp(-x)), and tanh(x) is 2 / (1 + exp(-2x)) - 1, which is faster; exp may overflow to infinity
        sign = np.r_[-np.ones(2 * h, np.float32), np.full(h, -2, np.float32)]
        # both directions at once: the second reads the words from the other end, and its windows are in that order too
        enter = [np.ascontiguousarray((np.r_[w[f"x{side}"], w[f"b{side}"][None]] * sign).T) for side in "fb"]
        inner = np.stack([np.ascontiguousarray((w[f"u{side}"] * sign).T) for side in "fb"])
        outer = [np.ascontiguousarray(-2 * part.T) for part in (w["a"][:h], w["a"][h:])]
        ones = np.c_[inputs, np.ones(len(inputs), np.float32)]
        one, two, last = np.float32(1), np.float32(2), w["o"].reshape(2, 1, 1, h)
        # kept from block to block: fresh memory costs more than what is done with it
        room = min(size, count)
        x_all, hu_all = np.empty((2, 3 * h, room + steps - 1), np.float32), np.empty((2, 3 * h, room), np.float32)
        states_all = np.empty((2, steps, h, room), np.float32)

        def states_of(near: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
            """States (direction, step, unit, window) and the outputs of each place of each window."""
            x, hu, states, own = x_all[..., : len(near)], hu_all[..., :n], states_all[..., :n], ones[near]
            np.matmul(enter[0], own.T, out=x[0])
            np.matmul(enter[1], own[::-1].copy().T, out=x[1])
            gates, new, keep, reset = hu[:, : 2 * h], hu[:, 2 * h :], hu[:, :h], hu[:, h : 2 * h]
            for t in range(steps):
                state = states[:, t]
                if t:
                    np.matmul(inner[0], before[0], out=hu[0])
                    np.matmul(inner[1], before[1], out=hu[1])
                    gates += x[:, : 2 * h, t : t + n]
                    np.exp(gates, out=gates)
                    gates += one
                    new /= reset
                    new += x[:, 2 * h :, t : t + n]
                    np.exp(new, out=new)
                else:
                    np.exp(x[:, :h, :n], out=keep)
                    keep += one
                    np.exp(x[:, 2 * h :, :n], out=new)
                new += one
                np.divide(two, new, out=new)
                new -= one
                before = np.subtract(before, new, out=state) if t else np.negative(new, out=state)
                state /= keep
                state += new
            each = np.matmul(last, states)[:, :, 0]
            return states, each[0] + each[1, ::-1, ::-1]

        def attend(states: np.ndarray, each: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Logits of some windows of a block, and the mean weight of each place."""
            n = each.shape[1]
            every = len(at) == n
            one_way = states[0] if every else states[0].take(at, axis=2)
            other = np.ascontiguousarray(states[1][..., ::-1]) if every else states[1].take(n - 1 - at, axis=2)
            hidden = np.matmul(outer[0], one_way)
            hidden += np.matmul(outer[1], other)[::-1]
            hidden -= 2 * w["a0"][:, None]
            np.exp(hidden, out=hidden)
            hidden += one
            np.reciprocal(hidden, out=hidden)
            # the -1 of each tanh adds the same to all energies of a window
            energy = np.matmul(2 * w["v"], hidden)
            weight = np.exp(energy - energy.max(axis=0))
            weight /= weight.sum(axis=0)
            return (weight * (each if every else each.take(at, axis=1))).sum(axis=0) + w["c"], weight.mean(axis=1)

        out = np.full(max(count, 0), -np.inf, np.float32)
        usual = np.full(steps, 1 / steps, np.float32)
        best = np.full(0 if owner is None else int(owner.max()) + 2, -np.inf, np.float32)  # of each text; the last is of none
        with np.errstate(over="ignore"):
            for i in range(0, count, size):
                n = min(size, count - i)
                states, each = states_of(types[i : i + n + steps - 1], n)
                if owner is None:
                    out[i : i + n], _ = attend(states, each, np.arange(n))
                    continue
                text = owner[i : i + n]
                # the window of each text that is greatest by usual weights, then those whose bound is above what is found
                head, guess = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]), usual @ each
                first = (guess >= np.repeat(np.maximum.reduceat(guess, head), np.diff(np.r_[head, n]))) & (text >= 0)
                bound = each.max(axis=0) + w["c"] + np.float32(1e-4)  # more than rounding may add
                for more in (False, True):
                    at = np.flatnonzero((text >= 0) & ~first & (bound >= best[text]) if more else first)
                    if len(at):
                        out[i + at], usual = attend(states, each, at)
                        np.maximum.at(best, text[at], out[i + at])
        return out

    def gradients(self, words: Words, rows: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        inputs = self.inputs(words)
        logits, (sides, both, hidden, alpha, pooled) = self.forward(self.project(inputs), rows, mask, True)
        grads = {k: np.zeros_like(v) for k, v in self.w.items() if k[0] in "uxb"}
        d = ((_sigmoid(logits) - y) * weight / len(y)).astype(np.float32)
        grads["o"], grads["c"] = pooled.T @ d, d.sum()
        d_pooled = d[:, None] * self.w["o"]
        d_both = alpha[:, :, None] * d_pooled
        d_alpha = np.einsum("tnh,nh->tn", both, d_pooled)
        d_energy = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        d_hidden = d_energy[:, :, None] * self.w["v"] * (1 - hidden**2)
        grads["v"] = (hidden * d_energy[:, :, None]).sum(axis=(0, 1))
        grads["a"], grads["a0"] = np.tensordot(both, d_hidden, ((0, 1), (0, 1))), d_hidden.sum(axis=(0, 1))
        d_both = d_both + d_hidden @ self.w["a"].T
        h, d_inputs, flat = self.p.hidden, np.zeros_like(inputs), rows.ravel()
        for side, part in (("f", d_both[:, :, :h]), ("b", d_both[:, :, h:])):
            d_x = self._layer_back(side, sides[side][1], mask, part, grads) * mask[:, :, None]
            d_x = d_x.reshape(-1, 3 * h)
            per = np.stack([np.bincount(flat, d_x[:, j], len(inputs)) for j in range(3 * h)], axis=1).astype(np.float32)
            grads[f"x{side}"], grads[f"b{side}"] = inputs.T @ per, per.sum(axis=0)
            d_inputs += per @ self.w[f"x{side}"].T
        n = np.diff(words.gram_first)
        spread = np.repeat(d_inputs / np.maximum(n, 1)[:, None], n, axis=0)
        for name, own, part in (("word", words.bucket, d_inputs), ("gram", words.grams, spread)):
            grads[name] = np.stack([np.bincount(own, part[:, j], len(self.w[name])) for j in range(self.p.dim)], axis=1).astype(np.float32)
            grads[name][-1] = 0
        return grads


class _Adam:
    def __init__(self, net: Network):
        self.net, self.step = net, 0
        self.m = {k: np.zeros_like(v) for k, v in net.w.items()}
        self.s = {k: np.zeros_like(v) for k, v in net.w.items()}

    def apply(self, grads: dict) -> None:
        self.step += 1
        rate = self.net.p.rate * (1 - 0.999**self.step) ** 0.5 / (1 - 0.9**self.step)
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.s[k] = 0.999 * self.s[k] + 0.001 * g * g
            self.net.w[k] = (self.net.w[k] - rate * self.m[k] / (np.sqrt(self.s[k]) + 1e-8)).astype(np.float32)


@dataclass
class Model:
    net: Network
    slope: float = 1.0
    offset: float = 0.0

    def worst(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The greatest window logit of each text."""
        words = self.net.known(read_words(buf, offs, self.net.p))
        start, text, own = window_starts(words.first, self.net.p)
        out = self.net.logits(words, start, words.first[1:][text], text)
        return np.maximum.reduceat(out, own[:-1]) if len(out) else out

    def scores(self, column: pa.Array) -> np.ndarray:
        z = np.concatenate([np.zeros(0), *(self.worst(buf, offs) for _, buf, offs in text_slices(column))])
        return _sigmoid(self.slope * z + self.offset).astype(float)


def _platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and offset of the logits with the least weighted log loss, by damped Newton steps.

    The targets are drawn in a little by the number of rows, so that separable scores keep a finite slope.
    """
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x, prior = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])

    def loss(a: np.ndarray) -> float:
        m = x @ a
        return float((weight * (np.logaddexp(0, m) - target * m)).mean() + 1e-3 * ((a - prior) ** 2).sum())

    a = prior
    for _ in range(50):
        s = _sigmoid(x @ a)
        grad = x.T @ (weight * (s - target)) / len(y) + 2e-3 * (a - prior)
        hess = (x * (weight * s * (1 - s))[:, None]).T @ x / len(y) + 2e-3 * np.eye(2)
        move, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-4 and loss(a - size * move) > loss(a):
            size /= 2
        a = a - size * move
    return max(float(a[0]), 0.1), float(a[1])


def _subset(words: Words, at: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """The types that some windows need, and the windows' rows among them."""
    mask = (at >= 0).astype(np.float32)
    kinds, rows = np.unique(np.where(at >= 0, words.types[at], -1), return_inverse=True)
    kinds = np.maximum(kinds, 0)
    n = np.diff(words.gram_first)[kinds]
    return Words(np.zeros(0, np.int64), np.zeros(1, np.int64), words.bucket[kinds], _grams_of(words, kinds), np.r_[0, np.cumsum(n)]), rows.reshape(at.shape), mask


def train(column: pa.Array, y: np.ndarray, weight: np.ndarray, p: Toxicity) -> Model:
    """A toxic document is toxic somewhere: it is stood for by its worst windows, chosen anew in each round.

    The first choice is by the log odds of the windows' n-grams in toxic and in clean documents. Clean documents give random
    windows and the worst ones. Every fifth document is kept for calibration.
    """
    rng, aside = np.random.default_rng(p.seed), np.arange(len(y)) % 5 == 4
    raw = _joined([read_words(buf, offs, p) for _, buf, offs in text_slices(column, 1 << 20)])
    start, text, own = window_starts(raw.first, p)
    end = raw.first[1:][text]
    n = np.diff(raw.gram_first)
    # the distinct words and n-grams of each training document
    kinds = [np.unique(raw.types[a:b]) for a, b, no in zip(raw.first[:-1].tolist(), raw.first[1:].tolist(), aside.tolist(), strict=True) if not no]
    grams = [np.unique(_grams_of(raw, k)) for k in kinds]
    net = Network(p, _vocabulary([np.unique(raw.bucket[k]) for k in kinds], p), _vocabulary(grams, p))
    words = net.known(raw)
    # how many documents of either label have each n-gram
    with_one, with_none = np.zeros(len(net.grams) + 1), np.zeros(len(net.grams) + 1)
    for g, label in zip(grams, y[~aside], strict=True):
        (with_one if label else with_none)[np.unique(_number(g, net.grams))] += 1
    del raw, kinds, grams
    odds = np.log((with_one + 0.5) / (y[~aside].sum() + 1) / ((with_none + 0.5) / ((1 - y[~aside]).sum() + 1)))
    odds[-1] = -9.0
    best = np.maximum.reduceat(np.r_[odds[words.grams], -9.0], words.gram_first[:-1])
    best[n == 0] = -9.0
    value = np.full(len(start), -9.0)
    for i in range(p.window):
        inside = np.flatnonzero(start + i < end)
        value[inside] = np.maximum(value[inside], best[words.types[start[inside] + i]])

    adam, learn = _Adam(net), ~aside[text]
    for turn in range(p.rounds):
        top = np.maximum.reduceat(value, own[:-1])
        noise = rng.random(len(value))
        worst = value >= top[text] - 1e-6 if turn == 0 else (value >= np.minimum(top[text], 2.0)) & (value > -1e9)
        bad = np.flatnonzero(learn & (y[text] == 1) & worst)
        if len(bad) > p.places:
            bad = rng.choice(bad, p.places, replace=False)
        clean = learn & (y[text] == 0)
        some = np.flatnonzero(clean & (noise < np.minimum(1, p.negatives / np.diff(own)[text])))
        hard = np.flatnonzero(clean & (value >= top[text] - 1e-6))
        rows = np.r_[bad, some, hard]
        target = np.r_[np.ones(len(bad)), np.zeros(len(some) + len(hard))].astype(np.float32)
        share = len(rows) / (2 * max(1, len(bad))), len(rows) / (2 * max(1, len(some) + len(hard)))
        heft = np.where(target > 0, share[0], share[1]).astype(np.float32)
        batch = 256 if len(rows) > 4096 else 128
        for _ in range(max(p.epochs, -(-p.steps * batch // len(rows)))):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                part, where, mask = _subset(words, window_words(start[rows[pick]], end[rows[pick]], p))
                adam.apply(net.gradients(part, where, mask, target[pick], heft[pick]))
        value = net.logits(words, start, end)
    model = Model(net)
    z = np.maximum.reduceat(value, own[:-1]).astype(float)
    if len(set(y[aside].tolist())) == 2:
        model.slope, model.offset = _platt(z[aside], y[aside], weight[aside])
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> Model | None:
    """A model from labelled rows outside the held-out fold; None if they do not have both labels."""
    own = labels.select("doc_id", F.col("toxic").alias("y"))
    rows = labelled_texts(docs, own, "y", p.folds, p.held_out, p.fit_rows, p.fit_chars)
    y = np.array([r[2] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return None
    shares = dict(own.where(~in_fold("doc_id", p.folds, p.held_out) & F.col("y").isNotNull()).groupBy("y").count().collect())
    weight = np.array([shares[int(v)] / (y == v).sum() for v in y])
    return train(pa.array([r[1] for r in rows], pa.string()), y, weight / weight.mean(), p)


def score_toxicity(docs: DataFrame, model: Model | None, p: Toxicity = Toxicity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    The windows at every word (every p.stride words) of the whole text are scored; score is the calibrated probability of label 1 of the worst,
    predicted is 1 from p.threshold on. A null or empty text, or one without words, is one empty window and scored as such.
    Without a model (no labels, or one label only) every score is 0. A null doc_id is not held out. Repeated rows get equal
    scores. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), in_fold(id_col, p.folds, p.held_out).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column(2)) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= p.threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")
