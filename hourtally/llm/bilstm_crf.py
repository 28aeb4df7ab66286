"""A character tagger in numpy: a bidirectional LSTM under a linear-chain CRF.

Everything works on windows of equal length, ``codes[window, place]``; windows
at the end of a text are padded with class 0. The input of a gate is a table
row per character class, so that a step is one small matrix product. Training
is Adam on the negative log-likelihood of the tag sequences.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

FORBIDDEN = -1e4


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return (most + np.log(np.exp(x - most).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Parameters by name; ``allowed[a, b]`` says whether tag b may follow tag a, ``first`` which may begin."""

    allowed: np.ndarray
    first: np.ndarray
    parameters: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def start(classes: int, tags: int, hidden: int, allowed: np.ndarray, first: np.ndarray, seed: int) -> Tagger:
        random = np.random.default_rng(seed)
        normal = lambda *shape: random.normal(0, 1 / np.sqrt(hidden), shape).astype(np.float32)
        parameters = {"bias": np.zeros(tags, np.float32), "turn": np.zeros((tags, tags), np.float32)}
        for side in ("f", "b"):
            parameters[f"table_{side}"] = normal(classes, 4 * hidden)
            parameters[f"table_{side}"][:, hidden : 2 * hidden] += 1  # remember at first
            parameters[f"again_{side}"] = normal(hidden, 4 * hidden)
            parameters[f"emit_{side}"] = normal(hidden, tags)
        return Tagger(allowed, first, parameters)

    def _run(self, codes: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states in the order of reading, and what the way back needs."""
        table, again = self.parameters[f"table_{side}"], self.parameters[f"again_{side}"]
        many, length = codes.shape
        hidden = again.shape[0]
        h = np.zeros((many, hidden), np.float32)
        c = np.zeros_like(h)
        states, steps = np.empty((length, many, hidden), np.float32), []
        for t in range(length):
            z = table[codes[:, t]] + h @ again
            gates = _sigmoid(z[:, : 3 * hidden])
            i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
            g = np.tanh(z[:, 3 * hidden :])
            before, c = c, f * c + i * g
            tanh = np.tanh(c)
            if keep:
                steps.append((h, before, i, f, o, g, tanh))
            h = o * tanh
            states[t] = h
        return states, steps

    def _run_back(self, codes: np.ndarray, side: str, steps: list, slope: np.ndarray) -> dict[str, np.ndarray]:
        again = self.parameters[f"again_{side}"]
        table = np.zeros_like(self.parameters[f"table_{side}"])
        turned = np.zeros_like(again)
        dh, dc = np.zeros_like(slope[0]), np.zeros_like(slope[0])
        for t in range(len(steps) - 1, -1, -1):
            h, before, i, f, o, g, tanh = steps[t]
            dh = dh + slope[t]
            dc = dc + dh * o * (1 - tanh**2)
            dz = np.concatenate(
                [dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g**2)], axis=1
            )
            np.add.at(table, codes[:, t], dz)
            turned += h.T @ dz
            dh, dc = dz @ again.T, dc * f
        return {f"table_{side}": table, f"again_{side}": turned}

    def _turns(self) -> np.ndarray:
        return np.where(self.allowed, self.parameters["turn"], FORBIDDEN).astype(np.float32)

    def _emissions(self, codes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Scores ``[place, window, tag]``; the padding may only have the first tag."""
        forward, f_steps = self._run(codes, "f", keep)
        backward, b_steps = self._run(codes[:, ::-1], "b", keep)
        p = self.parameters
        scores = forward @ p["emit_f"] + backward[::-1] @ p["emit_b"] + p["bias"]
        scores[0][:, ~self.first] = FORBIDDEN
        scores[(codes == 0).T] = np.where(np.arange(len(p["bias"])) == 0, 0, FORBIDDEN)
        return scores, (forward, f_steps, backward, b_steps)

    def _sums(self, scores: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward sums in logarithms, and the total of each window."""
        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0]
        for t in range(1, len(scores)):
            ahead[t] = log_sum(ahead[t - 1][:, :, None] + turns, 1) + scores[t]
        for t in range(len(scores) - 2, -1, -1):
            behind[t] = log_sum(turns + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
        return ahead, behind, log_sum(ahead[-1], 1)

    def loss(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log-likelihood of ``tags`` and its slope for every parameter."""
        p, turns = self.parameters, self._turns()
        scores, (forward, f_steps, backward, b_steps) = self._emissions(codes, keep=True)
        ahead, behind, total = self._sums(scores, turns)
        many, length = codes.shape
        windows = np.arange(many)
        at = tags.T
        gold = scores[np.arange(length)[:, None], windows, at].sum(axis=0) + turns[at[:-1], at[1:]].sum(axis=0)
        slope = np.exp(np.minimum(ahead + behind - total[:, None], 0))
        slope[np.arange(length)[:, None], windows, at] -= 1
        slope[(codes == 0).T] = 0
        slope[0][:, ~self.first] = 0
        slope /= many
        turn = np.zeros_like(turns)
        for t in range(1, length):
            joint = ahead[t - 1][:, :, None] + turns + (scores[t] + behind[t])[:, None, :] - total[:, None, None]
            turn += np.exp(np.minimum(joint, 0)).sum(axis=0)
        np.add.at(turn, (at[:-1].ravel(), at[1:].ravel()), -1)
        found = {
            "bias": slope.sum(axis=(0, 1)),
            "turn": np.where(self.allowed, turn / many, 0).astype(np.float32),
            "emit_f": np.einsum("tnh,tnk->hk", forward, slope, optimize=True),
            "emit_b": np.einsum("tnh,tnk->hk", backward[::-1], slope, optimize=True),
        }
        found |= self._run_back(codes, "f", f_steps, slope @ p["emit_f"].T)
        found |= self._run_back(codes[:, ::-1], "b", b_steps, (slope @ p["emit_b"].T)[::-1])
        return float((total - gold).mean()), found

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags ``[window, place]`` and the probability of each at its place."""
        turns = self._turns()
        scores, _ = self._emissions(codes)
        best = np.empty(scores.shape, dtype=np.int8)
        value = scores[0]
        for t in range(1, len(scores)):
            ways = value[:, :, None] + turns
            best[t] = ways.argmax(axis=1)
            value = ways.max(axis=1) + scores[t]
        windows = np.arange(len(codes))
        tags = np.empty(scores.shape[:2], dtype=np.int64)
        tags[-1] = value.argmax(axis=1)
        for t in range(len(scores) - 1, 0, -1):
            tags[t - 1] = best[t][windows, tags[t]]
        ahead, behind, total = self._sums(scores, turns)
        places = np.arange(len(scores))[:, None]
        sure = np.exp(np.minimum(ahead[places, windows, tags] + behind[places, windows, tags] - total, 0))
        return tags.T, sure.T


def train(tagger: Tagger, codes: np.ndarray, tags: np.ndarray, rounds: int, batch: int, rate: float, seed: int) -> Tagger:
    """Adam over shuffled batches, gradients cut at a norm of one."""
    random = np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in tagger.parameters.items()}
    square = {k: np.zeros_like(v) for k, v in tagger.parameters.items()}
    step, steps = 0, rounds * max(1, -(-len(codes) // batch))
    for _ in range(rounds):
        order = random.permutation(len(codes))
        for start in range(0, len(order), batch):
            part = order[start : start + batch]
            _, slopes = tagger.loss(codes[part], tags[part])
            norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in slopes.values()))
            step += 1
            pace = rate * (1 - (step - 1) / steps)
            for name, slope in slopes.items():
                slope = slope / max(1.0, norm)
                mean[name] = 0.9 * mean[name] + 0.1 * slope
                square[name] = 0.99 * square[name] + 0.01 * slope**2
                fair = (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)
                tagger.parameters[name] -= (pace * fair).astype(np.float32)
    return tagger
