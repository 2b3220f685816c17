"""Small numpy helpers for the networks trained here."""

from __future__ import annotations

import numpy as np


class Adam:
    """Adam steps over a dict of float32 arrays, in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.003):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.params[k] -= (scale * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)
