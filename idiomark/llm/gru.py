"""A bidirectional gated recurrent network with attention pooling, in numpy.

Two levels share the same layers: characters make the vector of a word, words
make the vector of a window. Arrays are time-major; a mask holds back padding.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def gru(x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = False):
    """States (T, B, H) of inputs already projected to the three gates (T, B, 3H); mask is (T, B, 1)."""
    steps, batch, wide = x.shape
    n = wide // 3
    h = np.zeros((batch, n), np.float32)
    out, cache = np.empty((steps, batch, n), np.float32), []
    for t in range(steps):
        a = h @ u
        gates = sigmoid(x[t, :, : 2 * n] + a[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        c = np.tanh(x[t, :, 2 * n :] + r * a[:, 2 * n :])
        if keep:
            cache.append((h, z, r, c, a[:, 2 * n :]))
        h = h + mask[t] * ((1 - z) * (c - h))
        out[t] = h
    return out, cache


def gru_back(d_out: np.ndarray, mask: np.ndarray, u: np.ndarray, cache) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of the projected inputs, gradient of u)."""
    steps, batch, n = d_out.shape
    dx, du = np.empty((steps, batch, 3 * n), np.float32), np.zeros_like(u)
    dh = np.zeros((batch, n), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, an = cache[t]
        dh = dh + d_out[t]
        g = dh * mask[t]
        dc = g * (1 - z) * (1 - c * c)
        dz = -g * (c - h) * z * (1 - z)
        dr = dc * an * r * (1 - r)
        dx[t, :, :n], dx[t, :, n : 2 * n], dx[t, :, 2 * n :] = dz, dr, dc
        da = np.concatenate([dz, dr, dc * r], 1)
        du += h.T @ da
        dh = dh - g * (1 - z) + da @ u.T
    return dx, du


def pool(states: np.ndarray, mask: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weighted mean over time, weights); the weights are a softmax of the states' products with v."""
    s = states @ v + (mask[:, :, 0] - 1) * np.float32(1e9)
    s = np.exp(s - s.max(0))
    w = s / s.sum(0)
    return np.einsum("tb,tbh->bh", w, states), w


def pool_back(d: np.ndarray, states: np.ndarray, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dw = np.einsum("bh,tbh->tb", d, states)
    ds = w * (dw - (w * dw).sum(0))
    return w[:, :, None] * d[None] + ds[:, :, None] * v, np.einsum("tb,tbh->h", ds, states)


class Layer:
    """Bidirectional recurrence and attention pooling; its parameters are p[name + suffix]."""

    def __init__(self, p: Params, name: str):
        self.p, self.name = p, name

    @staticmethod
    def new(name: str, inputs: int, hidden: int, rng: np.random.Generator) -> Params:
        def weight(a, b):
            return (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)

        p = {name + "v": (rng.standard_normal(2 * hidden) * 0.5).astype(np.float32)}
        for way in "fb":
            p |= {name + "w" + way: weight(inputs, 3 * hidden), name + "b" + way: np.zeros(3 * hidden, np.float32), name + "u" + way: weight(hidden, 3 * hidden)}
        return p

    def project(self, x: np.ndarray) -> list[np.ndarray]:
        return [x @ self.p[self.name + "w" + way] + self.p[self.name + "b" + way] for way in "fb"]

    def forward(self, projected: list[np.ndarray], mask: np.ndarray, keep: bool = False):
        f, cf = gru(projected[0], mask, self.p[self.name + "uf"], keep)
        b, cb = gru(projected[1][::-1], mask[::-1], self.p[self.name + "ub"], keep)
        states = np.concatenate([f, b[::-1]], 2)
        out, w = pool(states, mask, self.p[self.name + "v"])
        return out, (states, mask, w, cf, cb)

    def backward(self, d: np.ndarray, cache, grads: Params) -> list[np.ndarray]:
        """Gradients of the projected inputs, one for each direction."""
        states, mask, w, cf, cb = cache
        ds, grads[self.name + "v"] = pool_back(d, states, w, self.p[self.name + "v"])
        n = states.shape[2] // 2
        dxf, grads[self.name + "uf"] = gru_back(np.ascontiguousarray(ds[:, :, :n]), mask, self.p[self.name + "uf"], cf)
        dxb, grads[self.name + "ub"] = gru_back(np.ascontiguousarray(ds[::-1, :, n:]), mask[::-1], self.p[self.name + "ub"], cb)
        return [dxf, dxb[::-1]]

    def unproject(self, x: np.ndarray, d: list[np.ndarray], grads: Params) -> np.ndarray:
        """Gradient of x (rows, inputs) from those of its projections (rows, 3H)."""
        out = np.zeros_like(x)
        for way, g in zip("fb", d, strict=True):
            grads[self.name + "w" + way], grads[self.name + "b" + way] = x.T @ g, g.sum(0)
            out += g @ self.p[self.name + "w" + way].T
        return out


def summed(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sum of the values (n, k) by index into (rows, k)."""
    out = np.zeros((rows, values.shape[1]), np.float32)
    order = np.argsort(index, kind="stable")
    at = index[order]
    cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    if len(cuts):
        out[at[cuts]] = np.add.reduceat(values[order], cuts, axis=0)
    return out


CHARS, CHAR_DIM, CHAR_HIDDEN, WORDS, WORD_DIM, HIDDEN = 64, 8, 8, 4096, 8, 8


class Network:
    """Logit of a window of words. A word is a row of character codes (0 pads) and a bucket of a hashed embedding."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p: Params = {"ec": (rng.standard_normal((CHARS, CHAR_DIM)) * 0.5).astype(np.float32), "ew": (rng.standard_normal((WORDS, WORD_DIM)) * 0.05).astype(np.float32)}
        self.p |= Layer.new("c", CHAR_DIM, CHAR_HIDDEN, rng) | Layer.new("w", 2 * CHAR_HIDDEN + WORD_DIM, HIDDEN, rng)
        self.p |= {"o": (rng.standard_normal(2 * HIDDEN) * 0.5).astype(np.float32), "bias": np.zeros(1, np.float32)}
        self.chars, self.words = Layer(self.p, "c"), Layer(self.p, "w")

    def vectors(self, codes: np.ndarray, buckets: np.ndarray, keep: bool = False):
        """(word vectors, cache) of character codes (V, L) and buckets (V)."""
        lookup = self.chars.project(self.p["ec"])  # all that a character can be, projected once
        t = np.ascontiguousarray(codes.T)
        mask = (t > 0).astype(np.float32)[:, :, None]
        c, cache = self.chars.forward([x[t] for x in lookup], mask, keep)
        return np.concatenate([c, self.p["ew"][buckets]], 1), (t, cache)

    def projected(self, codes: np.ndarray, buckets: np.ndarray, step: int = 4096) -> list[np.ndarray]:
        """Words projected to the window layer's gates; rows in order of length are computed together."""
        length = (codes > 0).sum(1)
        order = np.argsort(length, kind="stable")
        out = [np.empty((len(codes), 3 * HIDDEN), np.float32) for _ in "fb"]
        for a in range(0, len(order), step):
            at = order[a : a + step]
            x, _ = self.vectors(codes[at, : max(1, int(length[at].max()))], buckets[at])
            for o, got in zip(out, self.words.project(x), strict=True):
                o[at] = got
        return out

    def logits(self, projected: list[np.ndarray], index: np.ndarray, step: int = 4096) -> np.ndarray:
        """Of windows (N, T) of word indices, -1 pads."""
        out = np.empty(len(index), np.float32)
        for a in range(0, len(index), step):
            t = np.ascontiguousarray(index[a : a + step].T)
            mask = (t >= 0).astype(np.float32)[:, :, None]
            v, _ = self.words.forward([x[t] for x in projected], mask)
            out[a : a + step] = v @ self.p["o"] + self.p["bias"]
        return out

    def gradients(self, codes: np.ndarray, buckets: np.ndarray, index: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, Params]:
        """(loss, gradients) of weighted cross entropy over windows."""
        x, (t, c_cache) = self.vectors(codes, buckets, True)
        both = self.words.project(x)
        i = np.ascontiguousarray(index.T)
        mask = (i >= 0).astype(np.float32)[:, :, None]
        v, w_cache = self.words.forward([b[i] for b in both], mask, True)
        logit = v @ self.p["o"] + self.p["bias"]
        prob = sigmoid(logit)
        loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum() / weight.sum())
        d = (weight * (prob - y) / weight.sum()).astype(np.float32)
        g: Params = {"o": v.T @ d, "bias": d.sum(keepdims=True)}
        dx = self.words.backward(d[:, None] * self.p["o"], w_cache, g)
        flat = i.reshape(-1)
        real = flat >= 0
        both = [summed(flat[real], q.reshape(-1, q.shape[2])[real], len(x)) for q in dx]
        d_word = self.words.unproject(x, both, g)
        g["ew"] = summed(buckets, d_word[:, 2 * CHAR_HIDDEN :], WORDS)
        dc = self.chars.backward(np.ascontiguousarray(d_word[:, : 2 * CHAR_HIDDEN]), c_cache, g)
        both = [summed(t.reshape(-1), q.reshape(-1, q.shape[2]), CHARS) for q in dc]
        g["ec"] = self.chars.unproject(self.p["ec"], both, g)
        return loss, g


class Adam:
    def __init__(self, p: Params, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.s = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: Params, rate: float | None = None) -> None:
        self.t += 1
        norm = float(np.sqrt(sum((x * x).sum() for x in g.values())))
        scale = min(1.0, 5.0 / max(norm, 1e-9))
        for k, x in g.items():
            x = x * np.float32(scale)
            self.m[k] += 0.1 * (x - self.m[k])
            self.s[k] += 0.005 * (x * x - self.s[k])
            up = (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.995**self.t)) + 1e-8)
            self.p[k] -= np.float32(rate or self.rate) * up.astype(np.float32)
