"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

Sylvester's law: the signs in D of an LDLᵀ factorisation of A - s I count the eigenvalues above and below s.  Bisection on
those counts isolates each leading eigenvalue; from there Rayleigh quotient iteration converges cubically; counts on both
sides of the result certify its number.  Works on the driver with one d x d matrix, whatever the number of rows.
"""

import numpy as np

# Fixed value of complete pivoting with 1 x 1 and 2 x 2 blocks: it bounds the growth of the entries.
ALPHA = (1 + 17 ** 0.5) / 8
EPS = np.finfo(float).eps


def factor(m):
    """(permutation, L, diagonal blocks) with m[p][:, p] = L D Lᵀ."""
    a, size = np.array(m, dtype=float), len(m)
    perm, lower, blocks, k = np.arange(size), np.eye(size), [], 0
    while k < size:
        rest = np.abs(a[k:, k:])
        p = int(np.argmax(np.diagonal(rest)))
        i, j = divmod(int(np.argmax(rest)), size - k)
        if rest[p, p] >= ALPHA * rest[i, j]:
            width, moves = 1, [(k, k + p)]
        else:
            i, j = sorted((i, j))
            width, moves = 2, [(k, k + i), (k + 1, k + j)]
        for x, y in moves:
            a[[x, y]] = a[[y, x]]
            a[:, [x, y]] = a[:, [y, x]]
            perm[[x, y]] = perm[[y, x]]
            lower[[x, y], :k] = lower[[y, x], :k]
        block, end = a[k:k + width, k:k + width].copy(), k + width
        blocks.append(block)
        if block.any() and end < size:
            column = a[end:, k:end].copy()
            low = np.linalg.solve(block, column.T).T
            lower[end:, k:end] = low
            a[end:, end:] -= low @ column.T
        k = end
    return perm, lower, blocks


def count_above(m, shift):
    """Number of eigenvalues of ``m`` greater than ``shift``."""
    _, _, blocks = factor(m - shift * np.eye(len(m)))
    # a 2 x 2 block is only chosen where its determinant is negative: one sign each
    return sum(1 if len(b) == 2 else int(b[0, 0] > 0) for b in blocks)


def solve_shifted(m, shift, b):
    """x with (m - shift I) x = b, scaled; a vanishing pivot is set to rounding size, as inverse iteration wants."""
    perm, lower, blocks = factor(m - shift * np.eye(len(m)))
    tiny = EPS * max(1e-300, float(np.abs(m).max()))
    y = np.linalg.solve(lower, b[perm])
    k = 0
    for block in blocks:
        end = k + len(block)
        if len(block) == 1:
            y[k] /= block[0, 0] if abs(block[0, 0]) > tiny else tiny
        else:
            y[k:end] = np.linalg.solve(block, y[k:end])
        k = end
    x = np.empty_like(y)
    x[perm] = np.linalg.solve(lower.T, y)
    return x / np.abs(x).max()


def leading(m, k):
    """(values, vectors as columns): the ``k`` largest eigenvalues of a symmetric matrix in falling order, unit vectors.

    Equal eigenvalues (closer than rounding can tell) get an orthonormal basis of their space.  Raises ArithmeticError if a
    count does not certify a value's number.
    """
    m = (m + m.T) / 2
    size = len(m)
    k = min(k, size)
    reach = float(np.abs(m).sum(axis=1).max()) if size else 0.0
    if reach == 0:
        return np.zeros(k), np.eye(size)[:, :k]
    known = {-2 * reach: size, 2 * reach: 0}  # shift -> eigenvalues above it
    floor_ = 8 * size * EPS * reach

    def above(shift):
        if shift not in known:
            known[shift] = count_above(m, shift)
        return known[shift]

    def bracket(j):
        """The closest known shifts around eigenvalue j (from 1)."""
        return max(s for s, c in known.items() if c >= j), min(s for s, c in known.items() if c < j)

    rng = np.random.default_rng(0)
    values, vectors = [], []
    while len(values) < k:
        j = len(values) + 1
        lo, hi = bracket(j)
        while known[lo] - known[hi] > 1 and hi - lo > floor_:
            above((lo + hi) / 2)
            lo, hi = bracket(j)
        if hi - lo <= floor_:  # as many equal eigenvalues as the counts say
            many = min(known[lo], k) - len(values)
        else:
            many = 1
        first = len(values)
        for _ in range(many):
            while True:
                value, vector = refine(m, lo, hi, [v for e, v in zip(values, vectors) if e - (lo + hi) / 2 <= 1e-3 * reach], rng, fixed=many > 1 or hi - lo <= floor_)
                if vector is not None:
                    break
                above((lo + hi) / 2)  # a neighbour attracted the iteration: a narrower bracket
                lo, hi = bracket(j)
                if hi - lo <= floor_:
                    many = 1
            values.append(value)
            vectors.append(vector)
        for n in range(first, len(values)):
            slack = np.abs(m @ vectors[n] - values[n] * vectors[n]).sum() + floor_
            if above(values[n] + slack) > n or above(values[n] - slack) < n + 1:
                raise ArithmeticError(f"eigenvalue {n + 1} is not certified")
    return np.array(values), np.column_stack(vectors) if vectors else np.zeros((size, 0))


def refine(m, lo, hi, close, rng, fixed):
    """The eigenpair in (lo, hi): two inverse iterations at the middle, then Rayleigh quotients; None if they leave the bracket.

    ``close`` are vectors already found whose values lie near; the iterates are kept orthogonal to them.
    """
    def unit(x):
        for _ in range(2):
            for v in close:
                x = x - (v @ x) * v
        return x / np.linalg.norm(x)

    middle, x = (lo + hi) / 2, unit(rng.standard_normal(len(m)))
    for _ in range(3 if fixed else 2):
        x = unit(solve_shifted(m, middle, x))
    value = float(x @ m @ x)
    scale = float(np.abs(m).sum(axis=1).max())
    best = np.inf
    for _ in range(12):
        residual = float(np.linalg.norm(m @ x - value * x))
        if residual <= 2 * EPS * scale or residual >= best or fixed:
            break
        best, kept = residual, (value, x)
        x = unit(solve_shifted(m, value, x))
        value = float(x @ m @ x)
    if not fixed and residual > best:
        value, x = kept
    return (value, x) if fixed or lo < value <= hi else (value, None)
