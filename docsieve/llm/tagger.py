"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, decoding and span confidence.

Arrays run over (time, batch). Tags are 0 for outside, 1 + 2k for the first character of
a span of kind k and 2 + 2k for the others.
"""

from __future__ import annotations

import numpy as np

NEVER = -1e4


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    def __init__(self, symbols: int, kinds: int, hidden: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden, self.tags = hidden, 1 + 2 * kinds
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0] if len(shape) > 1 else 1)).astype(np.float32)
        self.w: dict[str, np.ndarray] = {}
        for side in "fb":
            self.w[f"x{side}"] = draw(symbols, 4 * hidden)
            self.w[f"h{side}"] = draw(hidden, 4 * hidden)
            self.w[f"c{side}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)
        self.w["out"], self.w["bias"] = draw(2 * hidden, self.tags), np.zeros(self.tags, np.float32)
        self.w["move"], self.w["start"] = np.zeros((self.tags, self.tags), np.float32), np.zeros(self.tags, np.float32)
        self.barred = np.zeros((self.tags, self.tags), np.float32)
        for inner in range(2, self.tags, 2):
            self.barred[:, inner] = NEVER
            self.barred[[inner - 1, inner], inner] = 0

    def run_side(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """Hidden states in time order, and what the backward pass needs; the backward side reads from the end."""
        n, h_size = x.shape, self.hidden
        h, c = np.zeros((n[1], h_size), np.float32), np.zeros((n[1], h_size), np.float32)
        states, kept = np.empty((*n, h_size), np.float32), []
        fixed = self.w[f"x{side}"] + self.w[f"c{side}"]
        for t in range(n[0]) if side == "f" else range(n[0] - 1, -1, -1):
            z = fixed[x[t]] + h @ self.w[f"h{side}"]
            gates, g = sigmoid(z[:, : 3 * h_size]), np.tanh(z[:, 3 * h_size :])
            i, f, o = gates[:, :h_size], gates[:, h_size : 2 * h_size], gates[:, 2 * h_size :]
            before, c, last = c, f * c + i * g, h
            squashed = np.tanh(c)
            h = o * squashed
            states[t] = h
            kept.append((t, i, f, o, g, before, squashed, last))
        return states, kept

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        (forward, a), (backward, b) = self.run_side(x, "f"), self.run_side(x, "b")
        states = np.concatenate([forward, backward], axis=2)
        return states @ self.w["out"] + self.w["bias"], states, [a, b]

    def sums(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log sums from the left and from the right, and the log partition of each text."""
        move = self.w["move"] + self.barred
        left, right = np.empty_like(e), np.zeros_like(e)
        left[0] = e[0] + self.w["start"]
        for t in range(1, len(e)):
            left[t] = e[t] + log_sum(left[t - 1][:, :, None] + move, 1)
        for t in range(len(e) - 2, -1, -1):
            right[t] = log_sum(move + (e[t + 1] + right[t + 1])[:, None, :], 2)
        return left, right, log_sum(left[-1], 1)

    def marginals(self, e: np.ndarray) -> np.ndarray:
        left, right, total = self.sums(e)
        return np.exp(left + right - total[None, :, None])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of a batch and its gradients."""
        e, states, kept = self.emissions(x)
        left, right, total = self.sums(e)
        size, tags = x.shape[1], self.tags
        move = self.w["move"] + self.barred
        gold = np.eye(tags, dtype=np.float32)[y]
        score = (e * gold).sum() + self.w["start"][y[0]].sum() + move[y[:-1], y[1:]].sum()
        d = (np.exp(left + right - total[None, :, None]) - gold) / size
        pairs = np.zeros((tags, tags), np.float32)
        for t in range(len(e) - 1):
            pairs += np.exp(left[t][:, :, None] + move + (e[t + 1] + right[t + 1])[:, None, :] - total[:, None, None]).sum(axis=0)
        np.add.at(pairs, (y[:-1].ravel(), y[1:].ravel()), -1)
        grad = {"move": pairs / size, "start": d[0].sum(axis=0), "bias": d.sum(axis=(0, 1)), "out": states.reshape(-1, states.shape[2]).T @ d.reshape(-1, tags)}
        back = d @ self.w["out"].T
        h = self.hidden
        for side, part, steps in (("f", back[:, :, :h], kept[0]), ("b", back[:, :, h:], kept[1])):
            dh, dc = np.zeros((size, h), np.float32), np.zeros((size, h), np.float32)
            dx, dw = np.zeros_like(self.w[f"x{side}"]), np.zeros_like(self.w[f"h{side}"])
            hot = np.eye(len(dx), dtype=np.float32)
            for t, i, f, o, g, before, squashed, last in reversed(steps):
                dh = dh + part[t]
                dc = dc + dh * o * (1 - squashed * squashed)
                dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                dx += hot[x[t]].T @ dz
                dw += last.T @ dz
                dh, dc = dz @ self.w[f"h{side}"].T, dc * f
            grad[f"x{side}"], grad[f"h{side}"], grad[f"c{side}"] = dx, dw, dx.sum(axis=0)
        return float((total.sum() - score) / size), grad

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, step: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses, t, rounds = [], 0, max(1, epochs * -(-x.shape[1] // batch))
        for _ in range(epochs):
            order, loss = rng.permutation(x.shape[1]), 0.0
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                value, grad = self.gradients(x[:, pick], y[:, pick])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                t, scale = t + 1, min(1.0, 5 / max(norm, 1e-9))
                rate = step * (1 - 0.9 * t / rounds)
                for k, g in grad.items():
                    g = g * np.float32(scale)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.w[k] = (self.w[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
                loss += value * len(pick)
            losses.append(loss / len(order))
        return losses

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags (Viterbi) and the probability of each."""
        e, _, _ = self.emissions(x)
        move = self.w["move"] + self.barred
        best, back = e[0] + self.w["start"], np.zeros(e.shape, np.int8)
        for t in range(1, len(e)):
            options = best[:, :, None] + move
            back[t] = options.argmax(axis=1)
            best = e[t] + np.take_along_axis(options, back[t][:, None, :].astype(np.int64), 1)[:, 0]
        tags = np.empty(x.shape, np.int64)
        tags[-1] = best.argmax(axis=1)
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = np.take_along_axis(back[t], tags[t][:, None], 1)[:, 0]
        return tags, np.take_along_axis(self.marginals(e), tags[:, :, None], 2)[:, :, 0]
