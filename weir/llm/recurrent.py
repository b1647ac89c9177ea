"""Small recurrent networks in numpy: forward passes for many sequences at once, and backpropagation through time."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Adam:
    """The usual adaptive steps, over a dictionary of parameters."""

    def __init__(self, rate: float):
        self.rate, self.t = rate, 0
        self.m: dict[str, np.ndarray] = {}
        self.v: dict[str, np.ndarray] = {}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray], clip: float = 5.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, clip / (norm + 1e-9))
        for k, g in grads.items():
            g = g * scale
            m = self.m[k] = 0.9 * self.m.get(k, 0.0) + 0.1 * g
            v = self.v[k] = 0.99 * self.v.get(k, 0.0) + 0.01 * g * g
            params[k] -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)


def uniform(rng: np.random.Generator, rows: int, columns: int) -> np.ndarray:
    bound = np.sqrt(6.0 / (rows + columns))
    return rng.uniform(-bound, bound, (rows, columns)).astype(np.float32)


class Lstm:
    """One direction. Inputs are time x batch x width, with a mask of the steps that count; others leave the state alone."""

    def __init__(self, name: str, width: int, hidden: int, rng: np.random.Generator, params: dict[str, np.ndarray]):
        self.name, self.hidden = name, hidden
        params[name + "W"] = uniform(rng, width, 4 * hidden)
        params[name + "U"] = uniform(rng, hidden, 4 * hidden)
        bias = np.zeros(4 * hidden, np.float32)
        bias[hidden : 2 * hidden] = 1.0
        params[name + "b"] = bias

    def forward(self, p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        n, size, h = x.shape[0], x.shape[1], self.hidden
        drive = x @ p[self.name + "W"] + p[self.name + "b"]
        state, cell = np.zeros((size, h), np.float32), np.zeros((size, h), np.float32)
        out, tape = np.empty((n, size, h), np.float32), []
        u = p[self.name + "U"]
        for t in range(n):
            z = drive[t] + state @ u
            gates = sigmoid(z[:, : 3 * h])
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            m = mask[t][:, None]
            new_cell = f * cell + i * g
            squashed = np.tanh(new_cell)
            if keep:
                tape.append((state, cell, i, f, o, g, squashed, m))
            cell = m * new_cell + (1 - m) * cell
            state = m * (o * squashed) + (1 - m) * state
            out[t] = state
        return out, tape

    def backward(self, p: dict[str, np.ndarray], x: np.ndarray, tape: list, dout: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
        n, size, h = dout.shape
        u = p[self.name + "U"]
        dz = np.zeros((n, size, 4 * h), np.float32)
        dstate, dcell = np.zeros((size, h), np.float32), np.zeros((size, h), np.float32)
        du = np.zeros_like(u)
        for t in range(n - 1, -1, -1):
            state, cell, i, f, o, g, squashed, m = tape[t]
            dstate = dstate + dout[t]
            dh = dstate * m
            dc = dcell * m + dh * o * (1 - squashed * squashed)
            d = dz[t]
            d[:, :h] = dc * g * i * (1 - i)
            d[:, h : 2 * h] = dc * cell * f * (1 - f)
            d[:, 2 * h : 3 * h] = dh * squashed * o * (1 - o)
            d[:, 3 * h :] = dc * i * (1 - g * g)
            du += state.T @ d
            dstate = d @ u.T + dstate * (1 - m)
            dcell = dc * f + dcell * (1 - m)
        flat = dz.reshape(-1, 4 * h)
        grads[self.name + "W"] = x.reshape(-1, x.shape[2]).T @ flat
        grads[self.name + "U"] = du
        grads[self.name + "b"] = flat.sum(0)
        return dz @ p[self.name + "W"].T


class Gru:
    """One direction of a gated recurrent unit, with the same conventions; `drive` is the input already multiplied by W."""

    def __init__(self, name: str, hidden: int, rng: np.random.Generator, params: dict[str, np.ndarray]):
        self.name, self.hidden = name, hidden
        params[name + "U"] = uniform(rng, hidden, 3 * hidden)

    def forward(self, p: dict[str, np.ndarray], drive: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        n, size, _ = drive.shape
        h = self.hidden
        u = p[self.name + "U"]
        state, out, tape = np.zeros((size, h), np.float32), np.empty((n, size, h), np.float32), []
        for t in range(n):
            push = state @ u
            gates = sigmoid(drive[t][:, : 2 * h] + push[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            fresh = np.tanh(drive[t][:, 2 * h :] + r * push[:, 2 * h :])
            m = mask[t][:, None]
            if keep:
                tape.append((state, z, r, fresh, push[:, 2 * h :], m))
            state = state + m * (1 - z) * (fresh - state)
            out[t] = state
        return out, tape

    def backward(self, p: dict[str, np.ndarray], tape: list, dout: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
        n, size, h = dout.shape
        u = p[self.name + "U"]
        ddrive = np.zeros((n, size, 3 * h), np.float32)
        du, dstate = np.zeros_like(u), np.zeros((size, h), np.float32)
        for t in range(n - 1, -1, -1):
            state, z, r, fresh, push, m = tape[t]
            d = dstate + dout[t]
            dm = d * m
            dfresh = dm * (1 - z) * (1 - fresh * fresh)
            dzed = dm * (state - fresh) * z * (1 - z)
            dr = dfresh * push * r * (1 - r)
            ddrive[t] = np.concatenate([dzed, dr, dfresh], 1)
            back = np.concatenate([dzed, dr, dfresh * r], 1)
            du += state.T @ back
            dstate = d * (1 - m) + dm * z + back @ u.T
        grads[self.name + "U"] = du
        return ddrive
