"""Eigenvalues and eigenvectors of a symmetric integer matrix by its exact characteristic polynomial.

The matrix is as large as a vector is long, whatever the number of vectors behind it.
"""

from __future__ import annotations

from decimal import Decimal, localcontext

import numpy as np

DIGITS = 80  # of decimal arithmetic; roots are isolated to 2**-ROOT_BITS of their size
ROOT_BITS = 160


def primes_below(top: int, product_over: int) -> list[int]:
    """Primes downwards from *top* (at most 2**31) until their product exceeds *product_over*."""
    found, product, n = [], 1, top - 1 | 1
    while product <= product_over:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def _is_prime(n: int) -> bool:
    """Miller-Rabin with the bases 2, 3, 5 and 7, which decide every number below 2**31."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def hessenberg_polynomials(m: np.ndarray, primes: list[int]) -> np.ndarray:
    """Characteristic polynomial of *m* (Python integers) modulo each prime, constant term first."""
    p = np.array(primes, np.int64)
    d, every = len(m), np.arange(len(p))
    h = np.array([[[int(v) % q for v in row] for row in m] for q in primes], np.int64)
    col = p[:, None]
    for k in range(d - 2):
        below = h[:, k + 1:, k]
        pivot = (below != 0).argmax(1) + k + 1  # the first one that is not zero
        part = h[every, pivot].copy()
        h[every, pivot] = h[:, k + 1]
        h[:, k + 1] = part
        part = h[every, :, pivot].copy()
        h[every, :, pivot] = h[:, :, k + 1]
        h[:, :, k + 1] = part
        inverse = np.array([pow(int(v), -1, q) if v else 0 for v, q in zip(h[:, k + 1, k], primes)], np.int64)
        factor = h[:, k + 2:, k] * inverse[:, None] % col  # all zero where the column is done already
        h[:, k + 2:] = (h[:, k + 2:] - factor[:, :, None] * h[:, k + 1][:, None, :] % p[:, None, None]) % p[:, None, None]
        moved = h[:, :, k + 2:] * factor[:, None, :] % p[:, None, None]
        h[:, :, k + 1] = (h[:, :, k + 1] + moved.sum(2)) % col
    polys = [np.zeros((len(p), d + 1), np.int64)]
    polys[0][:, 0] = 1
    for k in range(d):
        new = np.zeros_like(polys[0])
        new[:, 1:] = polys[k][:, :-1]
        new = (new - h[:, k, k][:, None] * polys[k]) % col
        chain = np.ones(len(p), np.int64)
        for i in range(k - 1, -1, -1):
            chain = chain * h[:, i + 1, i] % p
            new = (new - (h[:, i, k] * chain % p)[:, None] * polys[i]) % col
        polys.append(new)
    return polys[d]


def characteristic_polynomial(m: np.ndarray) -> list[int]:
    """Exact coefficients, constant term first, of the symmetric matrix *m* of Python integers."""
    # no eigenvalue exceeds the largest row sum, so no coefficient exceeds (1 + that) ** d
    bound = (1 + max((sum(abs(int(v)) for v in row) for row in m), default=0)) ** len(m)
    primes = primes_below(1 << 31, 2 * bound)
    residues = hessenberg_polynomials(m, primes)
    product = 1
    for q in primes:
        product *= q
    weights = [product // q * pow(product // q, -1, q) for q in primes]
    out = []
    for k in range(len(m) + 1):
        value = sum(w * int(r) for w, r in zip(weights, residues[:, k])) % product
        out.append(value - product if 2 * value > product else value)
    return out


def roots_above(poly: list[int], a: int, bits: int) -> int:
    """How many roots exceed a / 2**bits, with multiplicity, if all roots are real (Descartes' rule is exact then)."""
    d = len(poly) - 1
    b = [v << bits * (d - k) for k, v in enumerate(poly)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            b[j] += a * b[j + 1]
    signs = [v > 0 for v in b if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(poly: list[int], a: int, bits: int) -> int:
    """Sign of the polynomial at a / 2**bits."""
    d = len(poly) - 1
    total = poly[d]
    for k in range(d - 1, -1, -1):
        total = total * a + (poly[k] << bits * (d - k))
    return (total > 0) - (total < 0)


def largest_roots(poly: list[int], count: int, top: int) -> list[tuple[int, int, int]]:
    """(a, bits, multiplicity) of the largest positive roots a / 2**bits, falling, *count* of them with multiplicity.

    *top* is at least the largest root. Roots that agree to ROOT_BITS count as one with their joint multiplicity.
    """
    found, need = [], count
    # an interval (low, high] / 2**bits with how many roots lie above either end; the highest is taken first
    stack = [(0, 1 << (top + 1).bit_length(), 0, roots_above(poly, 0, 0), 0)]
    while stack and need > 0:
        low, high, bits, above_low, above_high = stack.pop()
        inside = above_low - above_high
        if not inside:
            continue
        if inside == 1 and low:
            low, high, bits = _narrowed(poly, low, high, bits)
        if (high - low) << ROOT_BITS <= low:
            found.append((low + high, bits + 1, min(inside, need)))
            need -= inside
            continue
        low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        above = roots_above(poly, middle, bits)
        stack.append((low, middle, bits, above_low, above))
        stack.append((middle, high, bits, above, above_high))
    return found


def _narrowed(poly: list[int], low: int, high: int, bits: int) -> tuple[int, int, int]:
    """Halves an interval (low, high] that holds one simple root, by the sign alone; both ends are the root if it is met."""
    end = _sign(poly, high, bits)
    if not end:
        return high, high, bits
    while (high - low) << ROOT_BITS > low:
        low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        sign = _sign(poly, middle, bits)
        if not sign:
            return middle, middle, bits
        if sign == end:
            high = middle
        else:
            low = middle
    return low, high, bits


def _factored(a: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """LU with row exchanges of a matrix of Decimals, in place; a zero pivot becomes tiny."""
    d, order = len(a), []
    tiny = Decimal(10) ** (-2 * DIGITS) * (1 + max(abs(v) for row in a for v in row))
    for k in range(d):
        best = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        order.append(best)
        if best != k:
            a[[k, best]] = a[[best, k]]
        if not a[k, k]:
            a[k, k] = tiny
        a[k + 1:, k] = a[k + 1:, k] / a[k, k]
        a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k], a[k, k + 1:])
    return a, order


def _solved(lu: np.ndarray, order: list[int], b: np.ndarray) -> np.ndarray:
    x = b.copy()
    for k, best in enumerate(order):
        x[[k, best]] = x[[best, k]]
    for k in range(len(x)):  # the exchanges moved whole rows of the factors, so all of them came before
        x[k + 1:] -= lu[k + 1:, k] * x[k]
    for k in range(len(x) - 1, -1, -1):
        x[k] = x[k] / lu[k, k]
        x[:k] -= lu[:k, k] * x[k]
    return x


def eigenpairs(m: np.ndarray, count: int) -> list[tuple[Decimal, np.ndarray]]:
    """The largest positive eigenvalues of a positive semidefinite integer matrix with unit eigenvectors (doubles).

    Inverse iteration in decimal arithmetic on the matrix less the root, whose null space holds the
    eigenvectors; those of one root are made orthogonal. The entry of largest size is positive.
    """
    d = len(m)
    top = max((sum(abs(int(v)) for v in row) for row in m), default=0)
    out: list[tuple[Decimal, np.ndarray]] = []
    if not top:
        return out
    poly = characteristic_polynomial(m)
    start = np.random.default_rng(11)
    with localcontext() as context:
        context.prec = DIGITS
        whole = np.array([[Decimal(int(v)) for v in row] for row in m], dtype=object)
        for a, bits, multiplicity in largest_roots(poly, count, top):
            root = Decimal(a) / Decimal(1 << bits)
            shifted = whole.copy()
            for i in range(d):
                shifted[i, i] -= root
            lu, order = _factored(shifted)
            own: list[np.ndarray] = []
            for _ in range(multiplicity):
                x = np.array([Decimal(float(v)) for v in start.standard_normal(d)], dtype=object)
                for _ in range(3):
                    x = _solved(lu, order, x)
                    for v in own:
                        x = x - v * (v * x).sum()
                    x = x / (x * x).sum().sqrt()
                own.append(x)
            for x in own:
                big = max(range(d), key=lambda i: (abs(x[i]), -i))
                out.append((root, np.array([float(v) for v in (-x if x[big] < 0 else x)])))
    return out
