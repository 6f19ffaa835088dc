"""Arithmetic in the field of 2^61 - 1 elements, and set reconciliation over it."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

P = (1 << 61) - 1
#: Elements from here on are kept for sample points; hashes lie below.
POINTS_FROM = P - (1 << 20)

_P = np.uint64(P)
_LOW31 = np.uint64((1 << 31) - 1)
_LOW30 = np.uint64((1 << 30) - 1)


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Elementwise product mod P of uint64 arrays whose elements are below P."""
    s31, s30, s61 = np.uint64(31), np.uint64(30), np.uint64(61)
    ah, al, bh, bl = a >> s31, a & _LOW31, b >> s31, b & _LOW31
    mid = ah * bl + al * bh
    s = ((ah * bh) << np.uint64(1)) + (mid >> s30) + ((mid & _LOW30) << s31) + al * bl
    s = (s & _P) + (s >> s61)
    return np.where(s >= _P, s - _P, s)


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = a + b
    return np.where(s >= _P, s - _P, s)


def to_element(hashes: np.ndarray) -> np.ndarray:
    """Field elements below POINTS_FROM from signed 64-bit hashes."""
    return (hashes.view(np.uint64) >> np.uint64(3)) % np.uint64(POINTS_FROM)


def segment_products(factors: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Products of consecutive rows of ``factors``; ``starts``: each segment's first row."""
    values, ends = factors, np.append(starts[1:], len(factors))
    lengths = ends - starts
    while len(values) > len(lengths):
        # Halve every segment: multiply neighbours, keep a lone last row.
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        within = np.arange(len(values)) - np.repeat(first, lengths)
        n = np.repeat(lengths, lengths)
        lead = within % 2 == 0
        paired = lead & (within + 1 < n)
        out = values[lead].copy()
        at = np.flatnonzero(paired)
        out[paired[lead]] = mul(values[at], values[at + 1])
        values, lengths = out, (lengths + 1) // 2
    return values


def sample_points(n: int) -> np.ndarray:
    if n > P - POINTS_FROM:
        raise ValueError("more sample points than the field keeps free")
    return np.arange(P - n, P, dtype=np.uint64)


def _minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return add(a, _P - b)


def _scaled(poly: np.ndarray, factor: int) -> np.ndarray:
    return mul(poly, np.uint64(factor))


def _times_linear(poly: np.ndarray, root: int) -> np.ndarray:
    """poly * (z - root); coefficients from the constant up."""
    zero = np.zeros(1, np.uint64)
    return _minus(np.concatenate((zero, poly)), np.concatenate((_scaled(poly, root), zero)))


def _value(poly: np.ndarray, z: int) -> int:
    out = 0
    for c in reversed(poly.tolist()):
        out = (out * z + c) % P
    return out


def _trim(poly: np.ndarray) -> np.ndarray:
    some = np.flatnonzero(poly)
    return poly[: some[-1] + 1] if len(some) else poly[:0]


@lru_cache(maxsize=16)
def _through(bound: int, points: int) -> tuple[np.ndarray, list[int]]:
    """The polynomial that vanishes at the first points, and the inverses of 1, 2, ... (point distances)."""
    whole = np.ones(1, np.uint64)
    for z in sample_points(points)[:bound].tolist():
        whole = _times_linear(whole, z)
    return whole, [0, *(pow(j, -1, P) for j in range(1, bound))]


def _interpolate(values: list[int], zs: list[int], inverses: list[int]) -> np.ndarray:
    """The polynomial through equally spaced points: Newton's divided differences, then multiplied out."""
    coef = np.array(values, np.uint64)
    for j in range(1, len(values)):
        coef[j:] = _scaled(_minus(coef[j:], coef[j - 1 : -1]), inverses[j])
    out = coef[-1:].copy()
    for z, c in zip(zs[len(values) - 2 :: -1], coef[-2::-1]):
        out = _times_linear(out, z)
        out[0] = add(out[:1], np.array([c]))[0]
    return _trim(out)


def _divide_step(r0: np.ndarray, r1: np.ndarray, t0: np.ndarray, t1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Remainder of r0 by r1, and the cofactor that belongs to it."""
    inverse, r = pow(int(r1[-1]), -1, P), r0.copy()
    t = np.zeros(max(len(t0), len(t1) + len(r0) - len(r1)), np.uint64)
    t[: len(t0)] = t0
    for shift in range(len(r0) - len(r1), -1, -1):
        q = int(r[shift + len(r1) - 1]) * inverse % P
        if q:
            for target, part in ((r, r1), (t, t1)):
                at = slice(shift, shift + len(part))
                target[at] = _minus(target[at], _scaled(part, q))
    return _trim(r), _trim(t)


def reconcile(values_a: list[int], values_b: list[int], n_a: int, n_b: int, bound: int, checks: int) -> tuple[list[int], list[int]] | None:
    """Monic polynomials whose roots are the elements only in A and only in B.

    ``values_*`` are the characteristic polynomials at ``sample_points(bound +
    checks)``. Differences up to ``bound - 1`` are found: the rational function
    of least degree through the first ``bound`` points is verified at the others.
    None where none passes.
    """
    diff = n_a - n_b
    if abs(diff) > bound - 1:
        return None
    zs = sample_points(bound + checks).tolist()
    f = [a * pow(b, -1, P) % P for a, b in zip(values_a, values_b)]
    whole, inverses = _through(bound, bound + checks)
    # Extended Euclid down to the degree that A's differences can have.
    most_a = (bound - 1 + diff) // 2
    r0, r1 = whole, _interpolate(f[:bound], zs, inverses)
    t0, t1 = np.zeros(0, np.uint64), np.ones(1, np.uint64)
    while len(r1) - 1 > most_a:
        (r0, r1), (t0, t1) = zip((r1, t1), _divide_step(r0, r1, t0, t1))
    if not len(r1) or not len(t1) or r1[-1] != t1[-1]:
        return None
    lead = pow(int(r1[-1]), -1, P)
    pa, pb = _scaled(r1, lead), _scaled(t1, lead)
    if len(pa) - len(pb) != diff or any(_value(pa, z) != v * _value(pb, z) % P for z, v in zip(zs[bound:], f[bound:])):
        return None
    return pa.tolist(), pb.tolist()


def vanishes(elements: np.ndarray, polys: np.ndarray) -> np.ndarray:
    """Whether each element is a root of its polynomial (rows of coefficients, highest first)."""
    v = np.zeros(len(elements), np.uint64)
    for j in range(polys.shape[1]):
        v = add(mul(v, elements), polys[:, j])
    return v == 0
