"""The characteristic polynomial of a whole-number matrix, exactly, its real roots and its eigenvectors.

Modulo a prime, a matrix is brought to Hessenberg form by similarity and the polynomial follows by a recurrence. The
coefficients of the whole polynomial are put together from enough primes by Chinese remaindering; how many are enough
follows from a bound on the coefficients. A symmetric matrix has real roots only, so by Descartes' rule the sign changes
of the polynomial moved by a count the roots above a exactly: roots are isolated by halving intervals, in whole numbers.
Null-space vectors come from inverse iteration in fixed-point numbers of as many bits as are asked for.
"""

from __future__ import annotations

from math import isqrt

import numpy as np

WORD = 31  # bits of a prime: products of two residues fit 64 bits


def primes(bits: int) -> list[int]:
    """Primes below 2^31 in falling order whose product has more than ``bits`` bits."""
    out, have, p = [], 0, (1 << WORD) - 1
    while have <= bits:
        if _is_prime(p):
            out.append(p)
            have += WORD - 1
        p -= 2
    return out


def _is_prime(n: int) -> bool:
    """Miller-Rabin with the bases that decide all n below 2^32."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        x = pow(base, odd, n)
        if x in (1, n - 1) or base % n == 0:
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def residue(matrix, p: int) -> list[int]:
    """det(t - matrix) modulo p, constant term first, by Hessenberg reduction."""
    n = len(matrix)
    h = np.array([[int(v) % p for v in row] for row in matrix], np.int64).reshape(n, n)
    for j in range(n - 2):
        below = np.flatnonzero(h[j + 1:, j])
        if not len(below):
            continue
        k = j + 1 + below[0]
        if k != j + 1:  # the same swap of rows and columns keeps the polynomial
            h[[j + 1, k]] = h[[k, j + 1]]
            h[:, [j + 1, k]] = h[:, [k, j + 1]]
        factor = h[j + 2:, j] * pow(int(h[j + 1, j]), -1, p) % p
        h[j + 2:] = (h[j + 2:] - factor[:, None] * h[j + 1] % p) % p
        for i in np.flatnonzero(factor):  # one column at a time: a sum of products could pass 64 bits
            h[:, j + 1] = (h[:, j + 1] + factor[i] * h[:, j + 2 + i]) % p
    polynomials = [np.array([1], np.int64)]
    for k in range(n):
        now = np.zeros(k + 2, np.int64)
        now[1:] = polynomials[k]
        now[:-1] = (now[:-1] - int(h[k, k]) * polynomials[k]) % p
        product = 1
        for i in range(k - 1, -1, -1):
            product = product * int(h[i + 1, i]) % p
            if not product:
                break
            now[:i + 1] = (now[:i + 1] - int(h[i, k]) * product % p * polynomials[i]) % p
        polynomials.append(now)
    return polynomials[n].tolist()


def coefficient_bits(matrix) -> int:
    """A bound on the bits of a coefficient: each is a sum of minors, and with r the longest row at most (1 + r)^n."""
    longest = max((sum(int(v) ** 2 for v in row) for row in matrix), default=0)
    return len(matrix) * ((longest.bit_length() + 1) // 2 + 1) + 2


def combined(residues: list[tuple[int, list[int]]]) -> list[int]:
    """Whole coefficients from (prime, coefficients modulo it), by Chinese remaindering; signs by the nearest to zero."""
    modulus, out = 1, [0] * len(residues[0][1])
    for p, found in residues:
        inverse = pow(modulus % p, -1, p) if modulus > 1 else 1
        out = [c + modulus * ((r - c) * inverse % p) for c, r in zip(out, found)]
        modulus *= p
    return [c - modulus if 2 * c > modulus else c for c in out]


def above(polynomial: list[int], a: int, shift: int) -> int:
    """Roots greater than a / 2^shift, with multiplicity, of a polynomial that has real roots only."""
    degree = len(polynomial) - 1
    moved = [c << (shift * (degree - i)) for i, c in enumerate(polynomial)]  # of 2^shift t
    for i in range(degree):
        for j in range(degree - 1, i - 1, -1):
            moved[j] += a * moved[j + 1]
    signs = [c > 0 for c in moved if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(polynomial: list[int], count: int, bits: int) -> list[tuple[int, int]]:
    """The ``count`` largest roots of a polynomial whose roots are zero or more: [(cell, roots in it)], falling.

    A root in cell k lies above k / 2^bits and not above (k + 1) / 2^bits; that of zero is in cell -1. Roots of one cell
    are taken as equal.
    """
    degree = len(polynomial) - 1
    top = 1 + max((abs(c) for c in polynomial[:-1]), default=0).bit_length()
    # Cauchy's bound is far too high: the largest root is at most minus the next coefficient, the trace
    top = min(top, max(1, -polynomial[-2]).bit_length()) if degree else 0
    low, high = -1, 1 << top
    out, found = [], 0
    todo = [(low, high, 0, degree, 0)]  # ends times 2^shift, roots above the higher, above the lower, shift
    while todo and found < count:
        low, high, over, under, shift = todo.pop()
        if high - low == 1 and shift == bits:
            out.append((low, under - over))
            found += under - over
            continue
        if high - low == 1:
            low, high, shift = 2 * low, 2 * high, shift + 1
        middle = (low + high) // 2
        between = above(polynomial, middle, shift)
        if under > between:
            todo.append((low, middle, between, under, shift))
        if between > over:
            todo.append((middle, high, over, between, shift))
    return out


def null_space(matrix, root: int, many: int, bits: int, seed: int = 1) -> list[list[int]]:
    """``many`` orthogonal unit vectors (times 2^bits) the matrix multiplies by what is in cell ``root``, by inverse iteration.

    The matrix less the root is factorised once, with the largest pivots of each column, in fixed point.
    """
    n = len(matrix)
    a = [[(int(v) << bits) - (root if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
    order = list(range(n))
    tiny = 1
    for k in range(n):
        best = max(range(k, n), key=lambda i: abs(a[i][k]))
        a[k], a[best] = a[best], a[k]
        order[k], order[best] = order[best], order[k]
        if not a[k][k]:
            a[k][k] = tiny
        pivot = a[k][k]
        for i in range(k + 1, n):
            if a[i][k]:
                factor = (a[i][k] << bits) // pivot
                row, upper = a[i], a[k]
                row[k] = factor
                for j in range(k + 1, n):
                    row[j] -= factor * upper[j] >> bits
    draw = np.random.default_rng(seed)
    vectors = [[int(v) << (bits - 16) for v in draw.integers(-1 << 15, 1 << 15, n)] for _ in range(many)]
    for _ in range(3):
        solved = []
        for v in vectors:
            x = [v[i] for i in order]
            for i in range(n):
                x[i] -= sum(a[i][j] * x[j] for j in range(i)) >> bits
            for i in range(n - 1, -1, -1):
                x[i] = ((x[i] - (sum(a[i][j] * x[j] for j in range(i + 1, n)) >> bits)) << bits) // a[i][i]
            solved.append(x)
        vectors = _orthogonal(solved, bits)
    return vectors


def _orthogonal(vectors: list[list[int]], bits: int) -> list[list[int]]:
    """Gram-Schmidt, twice for each vector; unit length times 2^bits."""
    out: list[list[int]] = []
    for v in vectors:
        for _ in range(2):
            v = _unit(v, bits)
            for u in out:
                along = sum(x * y for x, y in zip(u, v)) >> bits
                v = [y - (along * x >> bits) for x, y in zip(u, v)]
        out.append(_unit(v, bits))
    return out


def _unit(v: list[int], bits: int) -> list[int]:
    most = max(map(abs, v)).bit_length()
    v = [x << (2 * bits - most) if most < 2 * bits else x >> (most - 2 * bits) for x in v]
    length = _root(sum(x * x for x in v))
    return [(x << bits) // length for x in v]


def _root(n: int) -> int:
    return max(1, isqrt(n))
