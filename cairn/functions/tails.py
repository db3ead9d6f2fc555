"""Tail probabilities of the normal and of Student's t distribution, for a few driver-side scalars."""

from __future__ import annotations

import itertools
import math

import numpy as np

NODES, WEIGHTS = np.polynomial.legendre.leggauss(24)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def student_two_sided(t: float, freedom: float) -> float:
    """Both tails beyond |t|, by integrating the density.

    With t = sqrt(freedom) * tan(a) the density becomes cos(a) ** (freedom - 1) over angles up to a right one, whose whole
    integral is known; the tail is summed over panels that widen from |t| on. Beyond ten million degrees of freedom
    the normal tail is the same in double precision."""
    if freedom > 1e7:
        return normal_two_sided(t)
    edges, step = [math.atan(abs(t) / math.sqrt(freedom))], 0.25 / math.sqrt(freedom)
    while edges[-1] < math.pi / 2:
        edges.append(min(math.pi / 2, edges[-1] + step))
        step *= 1.5
    tail = 0.0
    for low, high in itertools.pairwise(edges):
        angles = (low + high) / 2 + (high - low) / 2 * NODES
        tail += (high - low) / 2 * float(WEIGHTS @ np.exp((freedom - 1) * np.log(np.cos(angles))))
    whole = math.sqrt(math.pi) / 2 * math.exp(math.lgamma(freedom / 2) - math.lgamma((freedom + 1) / 2))
    return min(1.0, tail / whole)


#: Products of both sizes up to which arrangements are counted.
COUNTED = 200_000


def arrangements(n1: int, n2: int) -> list[int]:
    """How many of the arrangements of n1 and n2 untied rows have each value of U, from 0 to n1 * n2.

    Adding a row to the smaller side multiplies the generating function by (1 - x ** (n2 + i)) / (1 - x ** i)."""
    small, large = sorted((n1, n2))
    ways = np.zeros(small * large + 1, object)
    ways[0] = 1
    for i in range(1, small + 1):
        shift = large + i
        ways[shift:] = ways[shift:] - ways[: max(0, len(ways) - shift)] if shift < len(ways) else ways[shift:]
        for start in range(i):
            ways[start::i] = np.cumsum(ways[start::i])
    return ways.tolist()


def mann_whitney_two_sided(u: float, n1: int, n2: int, tie_sum: float) -> float:
    """The p-value of U: exact where a side has at most 8 rows and none are tied (and arrangements are few enough to be
    counted), else by the normal form with correction for ties and continuity."""
    top = max(u, n1 * n2 - u)
    if min(n1, n2) <= 8 and tie_sum == 0 and n1 * n2 <= COUNTED:
        ways = arrangements(n1, n2)
        return min(1.0, 2 * sum(ways[math.ceil(top) :]) / sum(ways))
    n = n1 + n2
    spread = n1 * n2 / 12 * (n + 1 - tie_sum / (n * (n - 1))) if n > 1 else 0.0
    return min(1.0, normal_two_sided(max(top - n1 * n2 / 2 - 0.5, 0.0) / math.sqrt(spread))) if spread > 0 else 1.0
