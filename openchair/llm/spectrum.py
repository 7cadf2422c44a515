"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The pivots of an LDLt factorization of `matrix - shift` have the signs of its eigenvalues, so one factorization counts the
eigenvalues above a shift. Bisection by these counts isolates each leading eigenvalue, Rayleigh quotient iteration converges
to it cubically from the middle of its interval, and two more counts certify its number.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
_PIVOT = (1 + 17**0.5) / 8
_ROUNDS = 12


def inertia(matrix: np.ndarray) -> tuple[int, int, int]:
    """How many eigenvalues are above, below and at zero: LDLt with pivots of one or two rows."""
    rest = np.array(matrix, dtype=float)
    positive = negative = zero = 0
    while len(rest):
        column = np.abs(rest[:, 0])
        corner, column[0] = column[0], 0.0
        far = int(column.argmax())
        largest = column[far]
        pair = False
        if corner < _PIVOT * largest:
            row = np.abs(rest[far])
            own, row[far] = row[far], 0.0
            most = row.max()
            if corner * most < _PIVOT * largest * largest:
                place = 0 if own >= _PIVOT * most else min(1, len(rest) - 1)
                order = np.arange(len(rest))
                order[[place, far]] = order[[far, place]]
                rest = rest[np.ix_(order, order)]
                pair = place == 1
        if pair:  # such a block has one eigenvalue on each side
            positive, negative = positive + 1, negative + 1
            side = rest[2:, :2]
            rest = rest[2:, 2:] - side @ np.linalg.solve(rest[:2, :2], side.T)
            continue
        pivot = rest[0, 0]
        if pivot == 0:
            zero += 1
            rest = rest[1:, 1:]
            continue
        positive, negative = positive + (pivot > 0), negative + (pivot < 0)
        side = rest[1:, 0]
        rest = rest[1:, 1:] - np.outer(side / pivot, side)
    return positive, negative, zero


class Spectrum:
    """Counts of the eigenvalues above shifts, remembered, and the eigenpairs found with them."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = (matrix + matrix.T) / 2
        self.size = len(matrix)
        self.norm = float(np.abs(self.matrix).sum(axis=1).max(initial=0.0))
        self.tolerance = 16 * max(self.size, 1) * EPS * self.norm
        edge = self.norm + self.tolerance
        self.counts = {-edge: self.size, edge: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = inertia(self.matrix - shift * np.eye(self.size))[0]
        return self.counts[shift]

    def isolate(self, number: int, width: float = np.inf) -> tuple[float, float]:
        """An interval that holds eigenvalue `number`, alone where it can be told from its neighbours."""
        low = max(shift for shift, n in self.counts.items() if n >= number)
        high = min(shift for shift, n in self.counts.items() if n < number and shift > low)
        while high - low > self.tolerance and (high - low > width or self.above(low) - self.above(high) > 1):
            middle = (low + high) / 2
            if not low < middle < high:
                break
            if self.above(middle) >= number:
                low = middle
            else:
                high = middle
        return low, high

    def _start(self, n: int) -> np.ndarray:
        return np.random.default_rng(self.size).standard_normal((self.size, n))

    def _solve(self, shift: float, right: np.ndarray) -> np.ndarray:
        for step in range(4):  # a shift that hits an eigenvalue exactly is moved by a rounding error
            try:
                return np.linalg.solve(self.matrix - (shift + step * EPS * self.norm) * np.eye(self.size), right)
            except np.linalg.LinAlgError:
                continue
        raise np.linalg.LinAlgError("no regular shift")

    def _iterate(self, low: float, high: float) -> tuple[float, np.ndarray] | None:
        """Rayleigh quotient iteration; None if it leaves the interval."""
        shift, x = (low + high) / 2, self._start(1)[:, 0]
        for _ in range(_ROUNDS):
            x = self._solve(shift, x)
            x /= np.linalg.norm(x)
            image = self.matrix @ x
            shift = float(x @ image)
            if np.linalg.norm(image - shift * x) <= self.tolerance / 4:
                return (shift, x) if low - self.tolerance <= shift <= high + self.tolerance else None
        return None

    def pair(self, number: int) -> tuple[float, np.ndarray]:
        low, high = self.isolate(number)
        while True:
            found = self._iterate(low, high)
            if found is not None:
                return found
            if high - low <= self.tolerance:
                raise ArithmeticError(f"eigenvalue {number} was not reached")
            low, high = self.isolate(number, (high - low) / 4)

    def certify(self, number: int, value: float) -> None:
        if not self.above(value + 2 * self.tolerance) < number <= self.above(value - 2 * self.tolerance):
            raise ArithmeticError(f"{value} is not eigenvalue {number}")


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to `most` eigenvalues by falling size, and unit eigenvectors as columns.

    Eigenvalues that rounding cannot tell apart share an orthonormal basis of their common space. Eigenvalues that it cannot
    tell from zero end the list, so it is shorter for a matrix of low rank.
    """
    largest = float(np.abs(matrix).max(initial=0.0))
    if largest == 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    scale = 2.0 ** np.floor(np.log2(largest))
    spectrum = Spectrum(matrix / scale)
    values: list[float] = []
    vectors = np.zeros((spectrum.size, 0))

    def add(value: float, vector: np.ndarray) -> None:
        nonlocal vectors
        for _ in range(2):
            vector = vector - vectors @ (vectors.T @ vector)
            vector = vector / np.linalg.norm(vector)
        values.append(value)
        vectors = np.column_stack([vectors, vector])

    while len(values) < min(most, spectrum.size):
        number = len(values) + 1
        low, high = spectrum.isolate(number)
        if high <= spectrum.tolerance:
            break
        together = spectrum.above(low) - number + 1
        if together <= 1:
            value, vector = spectrum.pair(number)
            if value <= spectrum.tolerance:
                break
            spectrum.certify(number, value)
            add(value, vector)
            continue
        basis = spectrum._start(together)
        for _ in range(3):
            basis = spectrum._solve((low + high) / 2, basis)
            basis, _ = np.linalg.qr(basis - vectors @ (vectors.T @ basis))
        for vector in basis.T[: most - len(values)]:
            value = float(vector @ spectrum.matrix @ vector)
            spectrum.certify(len(values) + 1, value)
            add(value, vector)
    return scale * np.array(values), vectors
