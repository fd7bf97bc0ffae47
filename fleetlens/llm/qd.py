"""Singular values and right singular directions of a small square matrix by qd methods, in numpy on the driver.

Householder reflections make the matrix upper bidiagonal; dqds finds the squared singular values from the squares of
the bidiagonal, never adding numbers of different sign, so that small ones keep their digits; each direction comes from
the twisted factorisation of the shifted tridiagonal whose middle pivot is least.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
#: From where an off-diagonal square is nothing beside the value it would change.
NOTHING = (8 * EPS) ** 2
#: Squared values closer than this share of their size get directions made orthogonal to each other.
CLOSE = 1e-3


def reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """v, beta, alpha with ``(I - beta v v') x = alpha e1``."""
    rest = np.abs(x[1:]).max(initial=0.0)
    if rest == 0:
        return x, 0.0, x[0]
    scale = max(rest, abs(x[0]))
    v = x / scale
    norm = np.sqrt(v @ v)
    alpha = -np.copysign(norm, v[0])
    v[0] -= alpha
    return v, 2 / (v @ v), alpha * scale


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and right factor P of ``matrix = Q B P'`` for a square matrix."""
    a = matrix.astype(np.float64)
    n = len(a)
    right = np.eye(n)
    main, upper = np.zeros(n), np.zeros(max(n - 1, 0))
    for k in range(n):
        v, beta, main[k] = reflector(a[k:, k].copy())
        if beta:
            a[k:, k + 1:] -= np.outer(beta * v, v @ a[k:, k + 1:])
        if k + 1 < n:
            v, beta, upper[k] = reflector(a[k, k + 1:].copy())
            if beta:
                a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k + 1:] @ v, beta * v)
                right[:, k + 1:] -= np.outer(right[:, k + 1:] @ v, beta * v)
    return main, upper, right


def _transformed(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential quotient-difference step: new q and e of the same spectrum less ``shift``, and the pivots on the way.

    A pivot below zero says that the shift was too large.
    """
    d = q[0] - shift
    out_q, out_e, pivots = [], [], [d]
    for i, off in enumerate(e):
        top = d + off
        ratio = q[i + 1] / top if top else 0.0
        out_q.append(top)
        out_e.append(off * ratio)
        d = d * ratio - shift if top else q[i + 1] - shift
        pivots.append(d)
    out_q.append(d)
    return out_q, out_e, pivots


def dqds(main: np.ndarray, upper: np.ndarray, most: int = 200) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling."""
    found: list[float] = []
    todo = [((main * main).tolist(), (upper * upper).tolist(), 0.0)]
    while todo:
        q, e, shift = todo.pop()
        steps = most * len(q)
        while e:
            if e[-1] <= NOTHING * (shift + q[-1]):
                found.append(shift + q.pop())
                e.pop()
                steps = max(steps, most)
                continue
            at = next((i for i in range(len(e) - 2, -1, -1) if e[i] <= NOTHING * (shift + min(q[i], q[i + 1]))), None)
            if at is not None:
                todo.append((q[:at + 1], e[:at], shift))
                q, e = q[at + 1:], e[at + 1:]
                continue
            if steps <= 0:
                raise ArithmeticError("singular values did not settle")
            steps -= 1
            if 1.5 * q[0] < q[-1]:  # least at the end, where values settle
                q, e = q[::-1], e[::-1]
            q, e, pivots = _transformed(q, e, 0.0)
            # reciprocals of the pivots are the diagonal of the inverse: their sum bounds the least value from below
            step = 1 / sum(1 / p for p in pivots) * (1 - 4 * len(q) * EPS) if min(pivots) > 0 else 0.0
            while step > EPS * EPS * shift:
                new = _transformed(q, e, step)
                if min(new[2]) >= 0:
                    q, e, shift = new[0], new[1], shift + step
                    break
                step /= 4
        found += [shift + x for x in q]
    return np.sort(np.maximum(found, 0))[::-1]


class Shifted:
    """``B'B - value`` of one unreduced bidiagonal block, factored from the top and from the bottom."""

    def __init__(self, main: np.ndarray, upper: np.ndarray, value: float):
        n, tiny = len(main), np.finfo(np.float64).tiny * 2 ** 60
        square = np.maximum(main * main, tiny)
        below = upper * main[:-1] / square[:-1]
        self.n, self.down, self.up = n, np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
        self.top = np.zeros(n)  # pivots from the top
        s, p = np.zeros(n), np.zeros(n)
        least = EPS * EPS * max(value, tiny)

        def safe(x: float) -> float:
            return x if abs(x) > least else least

        s[0] = -value
        for i in range(n - 1):
            self.top[i] = safe(s[i] + square[i])
            self.down[i] = square[i] * below[i] / self.top[i]
            s[i + 1] = self.down[i] * below[i] * s[i] - value
        self.top[n - 1] = safe(s[n - 1] + square[n - 1])
        p[n - 1] = square[n - 1] - value
        for i in range(n - 2, -1, -1):
            pivot = safe(square[i] * below[i] ** 2 + p[i + 1])
            ratio = square[i] / pivot
            self.up[i] = below[i] * ratio
            p[i] = p[i + 1] * ratio - value
        self.twist = int(np.argmin(np.abs(s + p + value)))

    def direction(self) -> np.ndarray:
        z = np.zeros(self.n)
        z[self.twist] = 1
        for i in range(self.twist - 1, -1, -1):
            z[i] = -self.down[i] * z[i + 1]
        for i in range(self.twist, self.n - 1):
            z[i + 1] = -self.up[i] * z[i]
        return z / np.linalg.norm(z)

    def solved(self, x: np.ndarray) -> np.ndarray:
        """The system's solution up to its length, through the factors from the top."""
        y = x.copy()
        for i in range(self.n - 1):
            y[i + 1] -= self.down[i] * y[i]
        y = y / self.top
        for i in range(self.n - 2, -1, -1):
            y[i] -= self.down[i] * y[i + 1]
        return y / np.linalg.norm(y)


def right_directions(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of a square matrix, at most ``most`` of them and none that is zero up to rounding, and
    as columns their right directions: unit, orthogonal, the entry of greatest size positive."""
    n = len(matrix)
    scale = np.abs(matrix).max(initial=0.0)
    if scale == 0:
        return np.zeros(0), np.zeros((n, 0))
    main, upper, right = bidiagonal(matrix / scale)
    size = max(np.abs(main).max(), np.abs(upper).max(initial=0.0))
    borders = np.flatnonzero(np.abs(upper) <= EPS * size) + 1  # as small as the rounding of the reflections
    blocks = list(zip([0, *borders], [*borders, n]))
    values = sorted(((x, a, b) for a, b in blocks for x in dqds(main[a:b], upper[a:b - 1])), key=lambda x: (-x[0], x[1]))
    values = [x for x in values[:most] if np.sqrt(x[0]) > 64 * n * EPS * np.sqrt(values[0][0])]
    columns: list[np.ndarray] = []
    for j, (value, a, b) in enumerate(values):
        near = [columns[i][a:b] for i in range(j) if values[i][1] == a and values[i][0] - value < CLOSE * values[i][0]]
        factored = Shifted(main[a:b], upper[a:b - 1], value)
        z = factored.direction()
        for turn in range(3 if near else 0):
            for _ in range(2):
                for other in near:
                    z = z - (other @ z) * other
            left = np.linalg.norm(z)
            if left < 1e-6:  # nothing but the earlier directions: start from another one
                z = np.cos((turn + 1) * np.arange(1, b - a + 1.0) ** 2)
            else:
                z = z / left
            if turn < 2:
                z = factored.solved(z)
        column = np.zeros(n)
        column[a:b] = z
        columns.append(column)
    out = right @ np.stack(columns, axis=1)
    out /= np.linalg.norm(out, axis=0)
    out *= np.sign(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])])
    return np.sqrt([x[0] for x in values]) * scale, out
