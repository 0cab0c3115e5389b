"""A small gated recurrent language model in numpy: training and scoring of token streams."""

from __future__ import annotations

import numpy as np

HIDDEN = 16
END, UNKNOWN = 0, 1    # the first two of the vocabulary
ROWS, WINDOW = 512, 16  # streams side by side in training, and steps of one backpropagation
RATE = 0.15


def _sigmoid(x):
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def _softmax(x):
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def _log_share(x, k):
    """Logarithm of the softmax of each row at its place `k`."""
    x -= x.max(axis=-1, keepdims=True)
    own = x[np.arange(len(x)), k]
    np.exp(x, out=x)
    return own - np.log(x.sum(axis=-1))


class Recurrent:
    """Gated recurrent units with an output factored by classes.

    P(word | state) = P(class | state) * P(word | class, state), with `classes` classes of as many
    words. Words are numbered by falling frequency, and word // classes is the class, so classes
    of frequent words come first.
    """

    def __init__(self, classes: int = 32, seed: int = 5):
        rng = np.random.default_rng(seed)
        h, c = HIDDEN, classes
        self.classes = c

        def new(*shape):
            return (rng.normal(size=shape) * 0.1).astype(np.float32)

        self.p = {"input": new(c * c, 3 * h), "gates": new(h, 2 * h), "state": new(h, h),
                  "classes": new(h, c), "class_bias": np.zeros(c, np.float32),
                  "words": new(c, h, c), "word_bias": np.zeros((c, c), np.float32)}
        self.square = {k: np.full_like(v, 1e-4) for k, v in self.p.items()}

    def flat(self) -> np.ndarray:
        """Weights and sums of squared gradients, end to end."""
        return np.concatenate([x.ravel() for t in (self.p, self.square) for x in t.values()])

    def load(self, flat: np.ndarray) -> Recurrent:
        lo = 0
        for t in (self.p, self.square):
            for k, x in t.items():
                t[k] = flat[lo:lo + x.size].astype(np.float32).reshape(x.shape)
                lo += x.size
        return self

    def step(self, x, s):
        """New state, and what training needs, from input words `x` and states `s`."""
        h, p = HIDDEN, self.p
        a = p["input"][x]
        g = _sigmoid(a[:, :2 * h] + s @ p["gates"])
        r, z = g[:, :h], g[:, h:]
        c = np.tanh(a[:, 2 * h:] + (r * s) @ p["state"])
        return s + z * (c - s), (x, s, r, z, c)

    def outputs(self, states, y):
        """Log10 probabilities of the words `y` after `states`, class by class."""
        p, classes = self.p, self.classes
        k = y // classes
        out = np.empty(len(y))
        order = np.argsort(k, kind="stable")
        cut = np.searchsorted(k[order], np.arange(classes + 1))
        for lo in range(0, len(y), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            out[at] = _log_share(states[at] @ p["classes"] + p["class_bias"], k[at])
        for c in range(classes):
            at = order[cut[c]:cut[c + 1]]
            if len(at):
                out[at] += _log_share(states[at] @ p["words"][c] + p["word_bias"][c], y[at] % classes)
        return out / np.log(10)

    def train(self, stream: np.ndarray, rows: int = ROWS, window: int = WINDOW) -> Recurrent:
        """Truncated backpropagation over `window` steps; the state goes on from window to window.

        The stream is laid out in `rows` rows, fewer where that gives under 32 windows, the last one filled up with
        ends. One AdaGrad step a window.
        """
        if len(stream) < 2:
            return self
        rows = max(1, min(rows, len(stream) // (32 * window)))
        steps = -(-(len(stream) - 1) // rows)
        full = np.full(rows * steps + 1, END, np.int64)
        full[:len(stream)] = stream
        x, y = full[:-1].reshape(rows, steps).T, full[1:].reshape(rows, steps).T
        s = np.zeros((rows, HIDDEN), np.float32)
        for lo in range(0, steps, window):
            s, grad = self._window(x[lo:lo + window], y[lo:lo + window], s)
            for k, g in grad.items():
                self.square[k] += g * g
                self.p[k] -= np.float32(RATE) * g / np.sqrt(self.square[k])
        return self

    def _window(self, x, y, s):
        p, h, classes = self.p, HIDDEN, self.classes
        kept, states = [], []
        for t in range(len(x)):
            s, memory = self.step(x[t], s)
            kept.append(memory)
            states.append(s)
        flat, target = np.concatenate(states), y.ravel()
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        order = np.argsort(target, kind="stable")          # by class, and by word in it
        flat, target = flat[order], target[order]
        k = target // classes
        d = _softmax(flat @ p["classes"] + p["class_bias"])
        d[np.arange(len(d)), k] -= 1
        grad["classes"], grad["class_bias"] = flat.T @ d, d.sum(0)
        back = d @ p["classes"].T
        cut = np.searchsorted(k, np.arange(classes + 1))
        for c in np.flatnonzero(np.diff(cut)):
            at = slice(cut[c], cut[c + 1])
            d = _softmax(flat[at] @ p["words"][c] + p["word_bias"][c])
            d[np.arange(len(d)), target[at] % classes] -= 1
            grad["words"][c], grad["word_bias"][c] = flat[at].T @ d, d.sum(0)
            back[at] += d @ p["words"][c].T
        whole = np.empty_like(back)
        whole[order] = back
        back = whole.reshape(len(x), -1, h) / np.float32(x.shape[1])
        carry = np.zeros_like(s)
        d_in = np.zeros((len(x), x.shape[1], 3 * h), np.float32)
        for t in range(len(x) - 1, -1, -1):
            _, old, r, z, c = kept[t]
            d = back[t] + carry
            dz, dc = d * (c - old) * z * (1 - z), d * z * (1 - c * c)
            through = dc @ p["state"].T
            dr = through * old * r * (1 - r)
            dg = np.concatenate([dr, dz], axis=1)
            grad["state"] += (r * old).T @ dc
            grad["gates"] += old.T @ dg
            d_in[t] = np.concatenate([dg, dc], axis=1)
            carry = d * (1 - z) + through * r + dg @ p["gates"].T
        word = x.ravel()
        order = np.argsort(word, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(word[order]) > 0])
        grad["input"][word[order][first]] = np.add.reduceat(d_in.reshape(-1, 3 * h)[order], first, axis=0)
        for k in ("classes", "class_bias", "words", "word_bias"):
            grad[k] /= x.shape[1]
        return s, grad

    def score(self, words: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Log10 probability of each word, in documents given by `cut`, each from a new state.

        All documents go on step by step together, the longest ones last; a document's state
        is carried through to its end, whatever its length.
        """
        size = np.diff(cut)
        order = np.argsort(-size, kind="stable")
        begin, size = cut[:-1][order], size[order]
        states = np.empty((len(words), HIDDEN), np.float32)
        s = np.zeros((len(order), HIDDEN), np.float32)
        before = np.full(len(order), END)
        live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        for t, n in enumerate(live.tolist()):
            s, _ = self.step(before[:n], s[:n])
            at = begin[:n] + t
            states[at] = s
            before = words[at]
        return self.outputs(states, words)
