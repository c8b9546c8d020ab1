"""A linear-chain conditional random field over hashed features, in numpy."""

from __future__ import annotations

import numpy as np

#: Hash buckets of the features.
FEATURES = 1 << 17
OUT, BEGIN, INSIDE = 0, 1, 2
#: Tokens of a chain that are decoded in one go; longer chains are decoded whole, block by block.
BLOCK = 128
_NEVER = -4.0  # a span never starts inside


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _padded(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of chains of a batch, and whether each is inside its chain."""
    t = np.arange(lengths.max())
    inside = t < lengths[:, None]
    return np.where(inside, starts[:, None] + t, starts[:, None]), inside


class Crf:
    """Weights of the features by label, and of the moves from label to label."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    @classmethod
    def fit(cls, ids: np.ndarray, labels: np.ndarray, lengths: np.ndarray, passes: int, batch: int = 64, rate: float = 0.25, decay: float = 1e-5) -> Crf:
        """Maximum likelihood by AdaGrad, with gradients from the forward-backward algorithm.

        ids: features of the tokens of all chains, end to end; lengths: tokens of each chain."""
        w, m = np.zeros((FEATURES, 3)), np.zeros((3, 3))
        m[OUT, INSIDE] = _NEVER
        gw, gm = np.full_like(w, 1e-2), np.full_like(m, 1e-2)
        starts, rng = np.cumsum(lengths) - lengths, np.random.default_rng(1)
        for _ in range(passes):
            order = rng.permutation(len(lengths))
            order = order[np.argsort(lengths[order] // 8, kind="stable")]
            batches = [order[i : i + batch] for i in range(0, len(order), batch)]
            for b in rng.permutation(len(batches)):
                at, inside = _padded(starts[batches[b]], lengths[batches[b]])
                rows = ids[at[inside]]
                used, spot = np.unique(rows, return_inverse=True)
                spot = spot.reshape(rows.shape)
                e = np.zeros((*at.shape, 3))
                e[inside] = w[used][spot].sum(1)
                n, longest, _ = e.shape
                fwd, bwd = np.zeros_like(e), np.zeros_like(e)
                fwd[:, 0] = e[:, 0] + [0, 0, _NEVER]
                for t in range(1, longest):
                    fwd[:, t] = np.where(inside[:, t, None], _logsum(fwd[:, t - 1, :, None] + m, 1) + e[:, t], fwd[:, t - 1])
                for t in range(longest - 2, -1, -1):
                    bwd[:, t] = np.where(inside[:, t + 1, None], _logsum(m + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), 0.0)
                z = _logsum(fwd[:, -1], 1)
                p = np.exp(fwd + bwd - z[:, None, None]) * inside[:, :, None]
                gold = np.zeros_like(p)
                gold[inside, labels[at[inside]]] = 1
                d = (gold - p)[inside]
                dw = np.stack([np.bincount(spot.ravel(), weights=np.repeat(d[:, k], rows.shape[1]), minlength=len(used)) for k in range(3)], axis=1)
                dm = np.zeros((3, 3))
                for t in range(1, longest):
                    pair = np.exp(fwd[:, t - 1, :, None] + m + (e[:, t] + bwd[:, t])[:, None, :] - z[:, None, None])
                    dm += ((gold[:, t - 1, :, None] * gold[:, t, None, :] - pair) * inside[:, t, None, None]).sum(0)
                dw -= decay * w[used]
                gw[used] += dw**2
                w[used] += rate * dw / np.sqrt(gw[used])
                gm += dm**2
                m += rate * dm / np.sqrt(gm)
                m[OUT, INSIDE] = _NEVER
        return cls(w.astype(np.float32), m.astype(np.float32))

    def emissions(self, features: list[np.ndarray]) -> np.ndarray:
        """Scores of the labels of each token, from its features (one array a feature)."""
        out = np.zeros((len(features[0]), 3), dtype=np.float32)
        for f in features:
            out += self.weights[f]
        return out

    def _forward(self, e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best score of each last label, and back pointers; `first` is added to the first token."""
        order = np.argsort(lengths, kind="stable")
        s, n = starts[order], lengths[order]
        best = e[s] + (first[order] if first.ndim == 2 else first)
        back = np.broadcast_to(np.arange(3, dtype=np.int8), (len(n), n[-1], 3)).copy()
        for t in range(1, n[-1]):
            k = int(np.searchsorted(n, t, side="right"))  # chains before k have ended
            x, y, z = (best[k:, i, None] + self.moves[i] for i in range(3))
            top = np.maximum(x, y)
            back[k:, t] = np.where(z > top, 2, y > x)
            best[k:] = np.maximum(top, z) + e[s[k:] + t]
        undo = np.argsort(order, kind="stable")
        return best[undo], back[undo]

    @staticmethod
    def _trace(back: np.ndarray, last: np.ndarray) -> np.ndarray:
        n, longest, _ = back.shape
        path, row = np.empty((n, longest), dtype=np.int8), np.arange(n)
        path[:, -1] = last
        for t in range(longest - 1, 0, -1):
            path[:, t - 1] = back[row, t, path[:, t]]
        return path

    def decode(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Most likely labels of all chains (Viterbi), end to end.

        A chain of more than `BLOCK` tokens is decoded whole: each block for each label it may be
        entered with, then the best way through the blocks."""
        out, starts = np.zeros(len(e), dtype=np.int8), np.cumsum(lengths) - lengths
        start = np.array([0, 0, _NEVER], dtype=np.float32)
        order = np.flatnonzero((lengths > 0) & (lengths <= BLOCK))
        order = order[np.argsort(lengths[order], kind="stable")]
        for i in range(0, len(order), 1024):
            s, n = starts[order[i : i + 1024]], lengths[order[i : i + 1024]]
            best, back = self._forward(e, s, n, start)
            at, inside = _padded(s, n)
            out[at[inside]] = self._trace(back, best.argmax(1))[inside]
        for c in np.flatnonzero(lengths > BLOCK):
            s = np.arange(starts[c], starts[c] + lengths[c], BLOCK)
            n = np.minimum(BLOCK, starts[c] + lengths[c] - s)
            through = [self._forward(e, s, n, np.where(np.arange(len(s))[:, None] == 0, start, self.moves[k])) for k in range(3)]
            score, came = through[0][0][0], np.zeros((len(s), 3), dtype=np.int8)
            for b in range(1, len(s)):
                step = score[:, None] + np.stack([through[k][0][b] for k in range(3)])
                came[b], score = step.argmax(0), step.max(0)
            last, entry = np.empty(len(s), dtype=np.int8), np.zeros(len(s), dtype=np.int8)
            last[-1] = score.argmax()
            for b in range(len(s) - 1, 0, -1):
                entry[b] = came[b, last[b]]
                last[b - 1] = entry[b]
            at, inside = _padded(s, n)
            back = np.where((entry == 0)[:, None, None], through[0][1], np.where((entry == 1)[:, None, None], through[1][1], through[2][1]))
            out[at[inside]] = self._trace(back, last)[inside]
        return out
