"""A bidirectional gated recurrent network with attention pooling, in numpy.

A window is a row of word classes; each class is a pair of levels, one from the word and one from its
characters, with an embedding each. States of both directions are pooled by attention weights and
give one logit.
"""

from __future__ import annotations

import numpy as np

LEVELS = 16  # of each of the two inputs
EMBED = 8
HIDDEN = 8


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiGRU:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def new(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        self.p = {"word": new(LEVELS, EMBED, scale=0.1), "char": new(LEVELS, EMBED, scale=0.1)}
        level = np.linspace(0, 1, LEVELS, dtype=np.float32)  # levels are ordered: let one input start with them
        self.p["word"][:, 0] += level
        self.p["char"][:, 1] += level
        for d in "fb":
            self.p[f"W{d}"] = new(EMBED, 3 * HIDDEN, scale=0.4)
            self.p[f"U{d}"] = new(HIDDEN, 3 * HIDDEN, scale=0.3)
            self.p[f"c{d}"] = np.zeros(3 * HIDDEN, np.float32)
        self.p |= {"A": new(2 * HIDDEN, HIDDEN, scale=0.3), "a": np.zeros(HIDDEN, np.float32), "v": new(HIDDEN, scale=0.3),
                   "o": new(2 * HIDDEN, scale=0.3), "o0": np.full(1, -1, np.float32)}

    def _inputs(self, d: str) -> np.ndarray:
        """What each class adds to the gates: a table, as classes are few."""
        p = self.p
        embedded = (p["word"][:, None, :] + p["char"][None, :, :]).reshape(-1, EMBED)
        return embedded @ p[f"W{d}"] + p[f"c{d}"]

    def _run(self, windows: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (steps, windows, HIDDEN) of one direction."""
        table, u = self._inputs(d), self.p[f"U{d}"]
        steps = range(windows.shape[1]) if d == "f" else range(windows.shape[1] - 1, -1, -1)
        h = np.zeros((len(windows), HIDDEN), np.float32)
        out = np.empty((windows.shape[1], len(windows), HIDDEN), np.float32)
        for t in steps:
            x, r = table[windows[:, t]], h @ u[:, :2 * HIDDEN]
            gates = _sigmoid(x[:, :2 * HIDDEN] + r)
            z, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN:] + (reset * h) @ u[:, 2 * HIDDEN:])
            if keep is not None:
                keep.append((t, h, z, reset, n))
            h = (1 - z) * n + z * h
            out[t] = h
        return out

    def _pool(self, states: np.ndarray):
        p = self.p
        hidden = np.tanh(states @ p["A"] + p["a"])
        energy = hidden @ p["v"]
        weights = np.exp(energy - energy.max(0))
        weights /= weights.sum(0)
        pooled = (weights[:, :, None] * states).sum(0)
        return hidden, weights, pooled, pooled @ p["o"] + p["o0"][0]

    def score(self, windows: np.ndarray, block: int = 4096) -> np.ndarray:
        out = [np.zeros(0, np.float32)]
        for i in range(0, len(windows), block):
            part = windows[i:i + block]
            states = np.concatenate((self._run(part, "f"), self._run(part, "b")), axis=2)
            out.append(_sigmoid(self._pool(states)[3]))
        return np.concatenate(out)

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy."""
        p, kept = self.p, {"f": [], "b": []}
        states = np.concatenate([self._run(windows, d, kept[d]) for d in "fb"], axis=2)
        hidden, weights, pooled, logit = self._pool(states)
        g = {k: np.zeros_like(x) for k, x in p.items()}
        d_logit = ((_sigmoid(logit) - target) / len(windows)).astype(np.float32)
        g["o"], g["o0"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["o"]
        d_states = weights[:, :, None] * d_pooled
        d_weights = (states * d_pooled).sum(2)
        d_energy = weights * (d_weights - (weights * d_weights).sum(0))
        g["v"] = np.einsum("twh,tw->h", hidden, d_energy)
        d_hidden = d_energy[:, :, None] * p["v"] * (1 - hidden ** 2)
        g["A"], g["a"] = np.einsum("twi,twh->ih", states, d_hidden), d_hidden.sum((0, 1))
        d_states = d_states + d_hidden @ p["A"].T
        embedded = (p["word"][:, None, :] + p["char"][None, :, :]).reshape(-1, EMBED)
        d_embedded = np.zeros_like(embedded)
        order = np.argsort(windows.T.ravel(), kind="stable")
        present, firsts = np.unique(windows.T.ravel()[order], return_index=True)
        for d, part in (("f", d_states[:, :, :HIDDEN]), ("b", d_states[:, :, HIDDEN:])):
            u, back = p[f"U{d}"], np.zeros((len(windows), HIDDEN), np.float32)
            d_inputs = np.empty((windows.shape[1], len(windows), 3 * HIDDEN), np.float32)
            for t, h, z, reset, n in reversed(kept[d]):
                d_h = back + part[t]
                d_n = d_h * (1 - z) * (1 - n ** 2)
                d_reset_h = d_n @ u[:, 2 * HIDDEN:].T
                d_gates = np.concatenate((d_h * (h - n) * z * (1 - z), d_reset_h * h * reset * (1 - reset)), axis=1)
                back = d_h * z + d_reset_h * reset + d_gates @ u[:, :2 * HIDDEN].T
                g[f"U{d}"][:, :2 * HIDDEN] += h.T @ d_gates
                g[f"U{d}"][:, 2 * HIDDEN:] += (reset * h).T @ d_n
                d_inputs[t, :, :2 * HIDDEN], d_inputs[t, :, 2 * HIDDEN:] = d_gates, d_n
            d_table = np.zeros((len(embedded), 3 * HIDDEN), np.float32)
            d_table[present] = np.add.reduceat(d_inputs.reshape(-1, 3 * HIDDEN)[order], firsts, axis=0)
            g[f"c{d}"] = d_table.sum(0)
            g[f"W{d}"] = embedded.T @ d_table
            d_embedded += d_table @ p[f"W{d}"].T
        d_embedded = d_embedded.reshape(LEVELS, LEVELS, EMBED)
        g["word"], g["char"] = d_embedded.sum(1), d_embedded.sum(0)
        return g

    def fit(self, windows: np.ndarray, target: np.ndarray, steps: int = 600, batch: int = 128, rate: float = 0.01, seed: int = 11) -> "BiGRU":
        """Adam over shuffled batches, the rate falling to a tenth."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        order, at = rng.permutation(len(windows)), 0
        for step in range(1, steps + 1):
            if at + batch > len(order):
                order, at = rng.permutation(len(windows)), 0
            pick, at = order[at:at + batch], at + batch
            for k, x in self.gradients(windows[pick], target[pick]).items():
                first[k] = 0.9 * first[k] + 0.1 * x
                second[k] = 0.99 * second[k] + 0.01 * x * x
                mean, spread = first[k] / (1 - 0.9 ** step), second[k] / (1 - 0.99 ** step)
                self.p[k] -= (rate * (1 - 0.9 * step / steps) * mean / (np.sqrt(spread) + 1e-7)).astype(np.float32)
        return self
