"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Characters are looked up in a table of gate inputs (embedding and input weights in one), two LSTMs read the
window from both sides, a linear layer gives tag scores, and a CRF with learned transitions and forbidden
``I`` tags after anything but their own kind decodes the window.
"""

from __future__ import annotations

import numpy as np

#: Symbols: padding, ASCII, other letters, other characters.
SYMBOLS = 131


def encode_chars(points: np.ndarray) -> np.ndarray:
    """Symbol of each code point; all digits are one symbol, and so are other letters."""
    out = np.where(points < 128, points + 1, 130)
    out = np.where((points >= 0xAA) & (points != 0xD7) & (points != 0xF7) & (points < 0x2000), 129, out)
    return np.where((points >= 48) & (points <= 57), ord("0") + 1, out).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Parameters and passes; ``kinds`` give the tags O, B-0, I-0, B-1, I-1, ..."""

    def __init__(self, kinds: int, hidden: int = 12, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.hidden, self.tags = hidden, 1 + 2 * kinds
        self.params = {"out": rng.normal(0, 0.3, (2 * hidden, self.tags)), "bias": np.zeros(self.tags), "trans": np.zeros((self.tags, self.tags))}
        for side in "fb":
            self.params["in" + side] = rng.normal(0, 0.3, (SYMBOLS, 4 * hidden))
            self.params["rec" + side] = rng.normal(0, 0.3, (hidden, 4 * hidden))
            self.params["in" + side][:, hidden : 2 * hidden] += 1  # forget gates start open
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}
        forbidden = np.zeros((self.tags, self.tags), np.float32)
        for k in range(kinds):
            inside = 2 + 2 * k
            forbidden[:, inside] = -1e4
            forbidden[[inside - 1, inside], inside] = 0
        self.forbidden = forbidden

    def _read(self, x: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        n, length = x.shape
        h, c, hidden = np.zeros((n, self.hidden), np.float32), np.zeros((n, self.hidden), np.float32), self.hidden
        table, rec = self.params["in" + side], self.params["rec" + side]
        out, tape = np.empty((length, n, hidden), np.float32), []
        for t in range(length) if side == "f" else range(length - 1, -1, -1):
            z = table[x[:, t]] + h @ rec
            gates = _sigmoid(z[:, : 3 * hidden])
            i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
            g = np.tanh(z[:, 3 * hidden :])
            before_c, before_h = c, h
            c = f * c + i * g
            squashed = np.tanh(c)
            h = o * squashed
            out[t] = h
            if keep:
                tape.append((t, i, f, o, g, before_c, squashed, before_h))
        return out, tape

    def emissions(self, x: np.ndarray, keep: bool = False):
        forward, tape_f = self._read(x, "f", keep)
        backward, tape_b = self._read(x, "b", keep)
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.params["out"] + self.params["bias"], both, tape_f, tape_b

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags of each window, ``n x length``; a window starts as if after O."""
        scores = self.emissions(x)[0]
        length, n, _ = scores.shape
        trans = self.params["trans"] + self.forbidden
        best, back = scores[0] + trans[0], []
        for t in range(1, length):
            path = best[:, :, None] + trans
            back.append(path.argmax(axis=1))
            best = path.max(axis=1) + scores[t]
        tags = np.empty((n, length), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(length - 2, -1, -1):
            tags[:, t] = back[t][np.arange(n), tags[:, t + 1]]
        return tags

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags ``y`` and its gradients."""
        scores, both, tape_f, tape_b = self.emissions(x, keep=True)
        length, n, tags = scores.shape
        trans = self.params["trans"] + self.forbidden

        def fold(z: np.ndarray, axis: int) -> np.ndarray:
            top = z.max(axis=axis, keepdims=True)
            return (top + np.log(np.exp(z - top).sum(axis=axis, keepdims=True))).squeeze(axis)

        alpha = [scores[0] + trans[0]]
        for t in range(1, length):
            alpha.append(fold(alpha[-1][:, :, None] + trans, 1) + scores[t])
        beta = [np.zeros((n, tags), np.float32)]
        for t in range(length - 1, 0, -1):
            beta.append(fold(trans + (scores[t] + beta[-1])[:, None, :], 2))
        beta = beta[::-1]
        total = fold(alpha[-1], 1)
        rows = np.arange(n)
        gold = scores[np.arange(length)[:, None], rows, y.T].sum(axis=0) + trans[0, y[:, 0]] + trans[y[:, :-1], y[:, 1:]].sum(axis=1)
        d_scores = np.exp(np.stack(alpha) + np.stack(beta) - total[None, :, None])
        d_trans = np.zeros_like(trans)
        d_trans[0] += d_scores[0].sum(axis=0)
        for t in range(1, length):
            d_trans += np.exp(alpha[t - 1][:, :, None] + trans + (scores[t] + beta[t])[:, None, :] - total[:, None, None]).sum(axis=0)
        np.subtract.at(d_trans, (np.zeros(n, int), y[:, 0]), 1)
        np.subtract.at(d_trans, (y[:, :-1], y[:, 1:]), 1)
        d_scores[np.arange(length)[:, None], rows, y.T] -= 1
        d_scores /= n
        grads = {"trans": d_trans / n, "bias": d_scores.sum(axis=(0, 1)), "out": np.einsum("tnh,tnk->hk", both, d_scores)}
        d_both = d_scores @ self.params["out"].T
        hidden = self.hidden
        for side, tape, d_h_all in (("f", tape_f, d_both[:, :, :hidden]), ("b", tape_b, d_both[:, :, hidden:])):
            rec = self.params["rec" + side]
            d_in, d_rec = np.zeros_like(self.params["in" + side]), np.zeros_like(rec)
            steps, symbols = [], []
            d_h, d_c = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
            for t, i, f, o, g, before_c, squashed, before_h in reversed(tape):
                d_h = d_h + d_h_all[t]
                d_c = d_c + d_h * o * (1 - squashed * squashed)
                d_z = np.concatenate([d_c * g * i * (1 - i), d_c * before_c * f * (1 - f), d_h * squashed * o * (1 - o), d_c * i * (1 - g * g)], axis=1)
                steps.append(d_z)
                symbols.append(x[:, t])
                d_rec += before_h.T @ d_z
                d_h, d_c = d_z @ rec.T, d_c * f
            flat = np.concatenate(symbols)
            order = np.argsort(flat, kind="stable")
            seen, first = np.unique(flat[order], return_index=True)
            d_in[seen] = np.add.reduceat(np.concatenate(steps)[order], first, axis=0)
            grads["in" + side], grads["rec" + side] = d_in, d_rec
        return float((total - gold).mean()), grads

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 128, rate: float = 0.03, seed: int = 1) -> list[float]:
        """Adam on random batches with gradients of bounded norm; the same data and seed give the same weights."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        losses = []
        for step in range(1, steps + 1):
            chosen = rng.integers(0, len(x), min(batch, len(x)))
            loss, grads = self.gradients(x[chosen], y[chosen])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            scale = min(1.0, 5.0 / max(norm, 1e-9))
            for k, g in grads.items():
                g = g * scale
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                size = rate * min(1.0, 2 * (1 - step / (steps + 1)))
                self.params[k] -= (size * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return losses
