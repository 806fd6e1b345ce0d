"""A bidirectional gated recurrent network in numpy: forward pass, backpropagation through time, Adam.

Arrays are (channels, sequences), one step of all sequences at a time.  Gates use
``x / (1 + |x|)``, scaled to 0..1 where a gate needs it: the same shape as the usual
squashing functions at a fraction of their cost.

    update u, reset v :  gate(x_u + U_u h),  gate(x_v + U_v h)
    candidate        :  squash(x_c + v * (U_c h))
    state            :  c + u * (h - c)

Inputs are columns of a table of pre-activations (3 H numbers per symbol), addressed by an
index matrix (steps, sequences).
"""

from __future__ import annotations

import io

import numpy as np

F4 = np.float32


def squash(x: np.ndarray) -> np.ndarray:
    d = np.abs(x)
    d += F4(1)
    return np.divide(x, d, out=d)


def gate(x: np.ndarray) -> np.ndarray:
    y = squash(x)
    y *= F4(0.5)
    y += F4(0.5)
    return y


def states(table: np.ndarray, recur: np.ndarray, index: np.ndarray, reverse: bool, trace: list | None = None) -> np.ndarray:
    """All states (steps, H, sequences) of one direction.  ``trace`` collects what the backward pass needs."""
    steps, n = index.shape
    size = recur.shape[1]
    out = np.empty((steps, size, n), F4)
    h = np.zeros((size, n), F4)
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        x = table.take(index[t], axis=1)
        g = recur @ h
        uv = x[:2 * size]
        uv += g[:2 * size]
        uv = gate(uv)
        c = uv[size:] * g[2 * size:]
        c += x[2 * size:]
        c = squash(c)
        new = h - c
        new *= uv[:size]
        new += c
        if trace is not None:
            trace.append((t, h, uv, c, g[2 * size:]))
        out[t] = h = new
    return out


def backward(recur: np.ndarray, trace: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the recurrent matrix and of the inputs (steps, 3 H, sequences), from those of the states."""
    steps, size, n = d_out.shape
    d_in = np.empty((steps, 3 * size, n), F4)
    d_recur = np.zeros_like(recur)
    carry = np.zeros((size, n), F4)
    for t, h, uv, c, gc in reversed(trace):
        d = d_out[t] + carry
        u, v = uv[:size], uv[size:]
        d_c = d * (1 - u) * (1 - np.abs(c)) ** 2
        slope = F4(0.5) * (1 - np.abs(2 * uv - 1)) ** 2
        d_in[t, :size] = d * (h - c) * slope[:size]
        d_in[t, size:2 * size] = d_c * gc * slope[size:]
        d_in[t, 2 * size:] = d_c
        d_g = d_in[t].copy()
        d_g[2 * size:] *= v
        d_recur += d_g @ h.T
        carry = d * u + recur.T @ d_g
    return d_recur, d_in


def table_gradient(index: np.ndarray, d_in: np.ndarray, symbols: int) -> np.ndarray:
    """Sum of the input gradients (steps, C, sequences) per symbol: (C, symbols)."""
    flat = index.ravel()
    rows = d_in.transpose(0, 2, 1).reshape(len(flat), -1)
    return sum_rows(flat, rows, symbols).T


def sum_rows(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, C) sums of the rows that share a key."""
    out = np.zeros((n, rows.shape[1]), F4)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        out[keys[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Adam:
    """Adam over a dict of arrays, updated in place."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray], clip: float = 5.0) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale = F4(min(1.0, clip / (norm + 1e-12)))
        rate = F4(self.rate * (1 - 0.999 ** self.t) ** 0.5 / (1 - 0.9 ** self.t))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += F4(0.1) * (g - self.m[k])
            self.v[k] += F4(0.001) * (g * g - self.v[k])
            self.w[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + F4(1e-7))


def start(rng: np.random.Generator, size: int) -> np.ndarray:
    """A recurrent matrix (3 H, H) of moderate gain."""
    return (rng.standard_normal((3 * size, size)) / np.sqrt(size)).astype(F4)


def pack(weights: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **weights)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}
