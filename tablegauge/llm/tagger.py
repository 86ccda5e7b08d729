"""A character tagger in numpy: two LSTMs, one per direction, and a CRF on top."""

from __future__ import annotations

import numpy as np

HIDDEN = 16


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _sum_logs(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Tags each symbol of fixed-length windows. ``allowed[a, b]`` says whether tag
    b may follow tag a, ``first`` which tags may begin a window."""

    def __init__(self, symbols: int, tags: int, allowed: np.ndarray, first: np.ndarray, hidden: int = HIDDEN, seed: int = 1):
        rng, h = np.random.default_rng(seed), hidden
        self.hidden, self.tags = h, tags
        self.banned = np.where(allowed, 0.0, -1e4)
        self.banned_first = np.where(first, 0.0, -1e4)
        p: dict[str, np.ndarray] = {}
        for d in "fb":  # forwards, backwards
            p[f"in_{d}"] = rng.normal(0, 0.3, (symbols, 4 * h))
            p[f"rec_{d}"] = rng.normal(0, h ** -0.5, (h, 4 * h))
            p[f"bias_{d}"] = np.concatenate((np.zeros(h), np.ones(h), np.zeros(2 * h)))
        p["out"] = rng.normal(0, (2 * h) ** -0.5, (2 * h, tags))
        p["out_bias"] = np.zeros(tags)
        p["step"] = np.zeros((tags, tags))
        p["start"] = np.zeros(tags)
        self.params = p

    # --- the two LSTMs ---

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        p, h = self.params, self.hidden
        state, cell = np.zeros((len(x), h)), np.zeros((len(x), h))
        out, kept = np.empty((x.shape[1], len(x), h)), []
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            z = p[f"in_{d}"][x[:, t]] + state @ p[f"rec_{d}"] + p[f"bias_{d}"]
            gates, new = _sigmoid(z[:, :3 * h]), np.tanh(z[:, 3 * h:])
            before, old = state, cell
            cell = gates[:, h:2 * h] * old + gates[:, :h] * new
            squashed = np.tanh(cell)
            state = gates[:, 2 * h:] * squashed
            out[t] = state
            kept.append((t, before, old, gates, new, squashed))
        return out, kept

    def _back(self, x: np.ndarray, d: str, kept: list, grad: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        p, h = self.params, self.hidden
        d_state, d_cell = np.zeros((len(x), h)), np.zeros((len(x), h))
        for t, before, old, gates, new, squashed in reversed(kept):
            d_state = d_state + grad[t]
            i, f, o = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
            d_cell = d_cell + d_state * o * (1 - squashed ** 2)
            z = np.concatenate((d_cell * new * i * (1 - i), d_cell * old * f * (1 - f), d_state * squashed * o * (1 - o), d_cell * i * (1 - new ** 2)), axis=1)
            np.add.at(grads[f"in_{d}"], x[:, t], z)
            grads[f"rec_{d}"] += before.T @ z
            grads[f"bias_{d}"] += z.sum(axis=0)
            d_state, d_cell = z @ p[f"rec_{d}"].T, d_cell * f

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores (step, window, tag) and what the gradient needs."""
        forth, kept_f = self._run(x, "f")
        back, kept_b = self._run(x, "b")
        both = np.concatenate((forth, back), axis=2)
        return both @ self.params["out"] + self.params["out_bias"], (both, kept_f, kept_b)

    # --- the CRF ---

    def _chain(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        step = self.params["step"] + self.banned
        ahead, behind = np.empty_like(e), np.zeros_like(e)
        ahead[0] = e[0] + self.params["start"] + self.banned_first
        for t in range(1, len(e)):
            ahead[t] = e[t] + _sum_logs(ahead[t - 1][:, :, None] + step, 1)
        for t in range(len(e) - 2, -1, -1):
            behind[t] = _sum_logs(step + (e[t + 1] + behind[t + 1])[:, None, :], 2)
        return ahead, behind, _sum_logs(ahead[-1], 1)

    def marginals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest tags (window, step) and each one's marginal probability."""
        e, _ = self.emissions(x)
        ahead, behind, total = self._chain(e)
        chance = np.exp(ahead + behind - total[None, :, None])
        step = self.params["step"] + self.banned
        best, came = e[0] + self.params["start"] + self.banned_first, []
        for t in range(1, len(e)):
            grid = best[:, :, None] + step
            came.append(grid.argmax(axis=1))
            best = grid.max(axis=1) + e[t]
        path = [best.argmax(axis=1)]
        for back in reversed(came):
            path.append(np.take_along_axis(back, path[-1][:, None], 1)[:, 0])
        tags = np.array(path[::-1])
        return tags.T, np.take_along_axis(chance, tags[:, :, None], 2)[:, :, 0].T

    def _gradient(self, x: np.ndarray, gold: np.ndarray) -> dict[str, np.ndarray]:
        e, (both, kept_f, kept_b) = self.emissions(x)
        ahead, behind, total = self._chain(e)
        step = self.params["step"] + self.banned
        grad = np.exp(ahead + behind - total[None, :, None])
        each, at = np.arange(len(x)), np.arange(x.shape[1])
        g = {k: np.zeros_like(v) for k, v in self.params.items()}
        for t in range(1, len(e)):
            pair = ahead[t - 1][:, :, None] + step + (e[t] + behind[t])[:, None, :] - total[:, None, None]
            g["step"] += np.exp(pair).sum(axis=0)
        np.subtract.at(g["step"], (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        grad[at[:, None], each[None, :], gold.T] -= 1
        grad /= len(x)
        g["step"] /= len(x)
        g["start"] = grad[0].sum(axis=0)
        g["out"] = np.einsum("tnh,tnk->hk", both, grad)
        g["out_bias"] = grad.sum(axis=(0, 1))
        inner = grad @ self.params["out"].T
        self._back(x, "f", kept_f, inner[:, :, :self.hidden], g)
        self._back(x, "b", kept_b, inner[:, :, self.hidden:], g)
        return g

    def train(self, x: np.ndarray, gold: np.ndarray, epochs: int = 8, size: int = 64, rate: float = 0.02, seed: int = 2) -> None:
        """Adam steps on windows ``x`` with tags ``gold``, in a fixed random order."""
        rng, count = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.params.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), size):
                own, count = order[at:at + size], count + 1
                for k, g in self._gradient(x[own], gold[own]).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.params[k] -= rate * (first[k] / (1 - 0.9 ** count)) / (np.sqrt(second[k] / (1 - 0.99 ** count)) + 1e-8)
