"""Linear-chain conditional random field over sparse binary features, with Viterbi decoding."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class LinearChainCrf:
    labels: list[str]
    index: dict[str, int] = field(default_factory=dict)
    emit: np.ndarray | None = None
    move: np.ndarray | None = None

    def _scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.emit[r].sum(axis=0) for r in rows])

    def _ids(self, seq: list[list[str]], grow: bool = False) -> list[np.ndarray]:
        ix = self.index
        if grow:
            for feats in seq:
                for f in feats:
                    ix.setdefault(f, len(ix))
        return [np.array([ix[f] for f in feats if f in ix], dtype=np.int64) for feats in seq]

    def fit(self, seqs: list[list[list[str]]], tags: list[list[str]], epochs: int = 12, rate: float = 0.4, l2: float = 1e-4, seed: int = 7) -> LinearChainCrf:
        """Maximises the conditional log-likelihood by AdaGrad over single sequences."""
        at = {t: i for i, t in enumerate(self.labels)}
        data = [(self._ids(s, grow=True), np.array([at[t] for t in y])) for s, y in zip(seqs, tags) if s]
        k = len(self.labels)
        self.emit, self.move = np.zeros((len(self.index), k)), np.zeros((k, k))
        seen_e, seen_m = np.full((len(self.index), k), 1e-8), np.full((k, k), 1e-8)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(data)):
                rows, y = data[i]
                node, edge = self._marginals(self._scores(rows))
                node[np.arange(len(y)), y] -= 1
                if len(y) > 1:
                    np.subtract.at(edge, (y[:-1], y[1:]), 1)
                edge += l2 * self.move
                seen_m += edge**2
                self.move -= rate * edge / np.sqrt(seen_m)
                for r, g in zip(rows, node):
                    grad = g + l2 * self.emit[r]
                    seen_e[r] += grad**2
                    self.emit[r] -= rate * grad / np.sqrt(seen_e[r])
        return self

    def _marginals(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node marginals and summed edge marginals by forward-backward in the log domain."""
        n, k = s.shape
        fwd, bwd = np.empty((n, k)), np.zeros((n, k))
        fwd[0] = s[0]
        for t in range(1, n):
            fwd[t] = s[t] + _lse(fwd[t - 1][:, None] + self.move, 0)
        for t in range(n - 2, -1, -1):
            bwd[t] = _lse(self.move + (s[t + 1] + bwd[t + 1])[None, :], 1)
        total = _lse(fwd[-1], 0)
        node = np.exp(fwd + bwd - total)
        edge = np.zeros((k, k))
        for t in range(1, n):
            edge += np.exp(fwd[t - 1][:, None] + self.move + (s[t] + bwd[t])[None, :] - total)
        return node, edge

    def decode(self, seq: list[list[str]]) -> list[str]:
        """The most likely label sequence."""
        if not seq:
            return []
        s = self._scores(self._ids(seq))
        n, k = s.shape
        back = np.empty((n, k), dtype=np.int64)
        best = s[0]
        for t in range(1, n):
            step = best[:, None] + self.move
            back[t] = step.argmax(axis=0)
            best = step[back[t], np.arange(k)] + s[t]
        out = [int(best.argmax())]
        for t in range(n - 1, 0, -1):
            out.append(int(back[t][out[-1]]))
        return [self.labels[i] for i in reversed(out)]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)
