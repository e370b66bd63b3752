"""Small dense solvers that run inside tasks.

They are sent to the workers by value, so executors need numpy and pandas but not this package.
"""

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def partial_from_cov(cov: pd.Series) -> pd.Series:
    """Partial correlation of the first two variables given the others, from a flattened covariance matrix."""
    out = []
    for flat in cov:
        m = int(round(len(flat) ** 0.5))
        c = np.asarray(flat, float).reshape(m, m)
        if not np.isfinite(c).all():
            out.append(None)
            continue
        sd = np.sqrt(np.diag(c))
        if (sd <= 0).any():
            out.append(None)
            continue
        c = c / np.outer(sd, sd)
        z = c[2:, 2:]
        if np.linalg.cond(z) > 1e8:
            out.append(None)
            continue
        s = c[:2, :2] - c[:2, 2:] @ np.linalg.solve(z, c[2:, :2])
        ok = s[0, 0] > 1e-12 and s[1, 1] > 1e-12
        out.append(float(np.clip(s[0, 1] / np.sqrt(s[0, 0] * s[1, 1]), -1, 1)) if ok else None)
    return pd.Series(out, dtype="float64")


def slopes_from_cov(zz: pd.Series, zx: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(zz, zx):
        k = len(b)
        out.append(np.linalg.lstsq(np.asarray(a, float).reshape(k, k), np.asarray(b, float), rcond=1e-10)[0].tolist())
    return pd.Series(out)


def inverse(xtx: pd.Series) -> pd.Series:
    out = []
    for flat in xtx:
        k = int(round(len(flat) ** 0.5))
        out.append(np.linalg.pinv(np.asarray(flat, float).reshape(k, k)).ravel().tolist())
    return pd.Series(out)


def filled(gram, med):
    """Cross products of (x with medians for missing, 1, y)."""
    p = len(med)
    t = np.zeros((p + 2, 2 * p + 2))
    t[:p, :p] = np.eye(p)
    t[:p, p:2 * p] = np.diag(med)
    t[p, 2 * p] = t[p + 1, 2 * p + 1] = 1.0
    return t @ gram @ t.T


def enet(g, alpha, l1, rounds=2000, tol=1e-9):
    """Elastic net on standardised columns from cross products: slopes in the data's units, intercept, scales, and whether
    the last sweep moved no slope by more than ``tol``."""
    p = len(g) - 2
    n = g[p, p]
    mu, my = g[:p, p] / n, g[p + 1, p] / n
    c = g[:p, :p] / n - np.outer(mu, mu)
    sd = np.sqrt(np.maximum(np.diag(c), 0))
    live = sd > 1e-9
    b = np.zeros(p)
    settled = True
    if live.any():
        s = sd[live]
        q = c[np.ix_(live, live)] / np.outer(s, s)
        r = (g[:p, p + 1] / n - mu * my)[live] / s
        w = np.zeros(len(s))
        if l1 == 0:
            w = np.linalg.solve(q + alpha * np.eye(len(s)), r)
        else:
            for _ in range(rounds):
                moved = 0.0
                for j in range(len(s)):
                    z = r[j] - q[j] @ w + q[j, j] * w[j]
                    new = np.sign(z) * max(abs(z) - alpha * l1, 0.0) / (q[j, j] + alpha * (1 - l1))
                    moved = max(moved, abs(new - w[j]))
                    w[j] = new
                if moved < tol:
                    break
            settled = moved < tol
        b[live] = w / s
    return b, my - b @ mu, sd, settled


def enet_many(g, sides, alpha, l1, rounds=2000, tol=1e-9):
    """The same for many targets with one X'X: slopes (p x targets), intercepts, and which targets settled.

    ``sides`` has a column for each target: X'y, sum y, sum y^2; ``alpha`` and ``l1`` one value each.  The descent runs over the
    coordinates with all targets as one row; a target leaves when a sweep moves none of its slopes by ``tol``.
    """
    p = len(g) - 2
    n = g[p, p]
    b, settled = np.zeros((p, sides.shape[1])), np.ones(sides.shape[1], dtype=bool)
    if n <= 0:
        return b, np.full(sides.shape[1], np.nan), settled
    mu, my = g[:p, p] / n, sides[p] / n
    c = g[:p, :p] / n - np.outer(mu, mu)
    sd = np.sqrt(np.maximum(np.diag(c), 0))
    live = sd > 1e-9
    if live.any():
        s = sd[live]
        q = c[np.ix_(live, live)] / np.outer(s, s)
        r = (sides[:p] / n - np.outer(mu, my))[live] / s[:, None]
        w = np.zeros(r.shape)
        for a in np.unique(alpha[l1 == 0]):
            ridge = (l1 == 0) & (alpha == a)
            w[:, ridge] = np.linalg.solve(q + a * np.eye(len(s)), r[:, ridge])
        active = np.flatnonzero(l1 != 0)
        for _ in range(rounds):
            if not len(active):
                break
            now, side = w[:, active], r[:, active]
            limit, down = (alpha * l1)[active], (alpha * (1 - l1))[active]
            moved = np.zeros(len(active))
            for j in range(len(s)):
                z = side[j] - q[j] @ now + q[j, j] * now[j]
                new = np.sign(z) * np.maximum(np.abs(z) - limit, 0.0) / (q[j, j] + down)
                moved = np.maximum(moved, np.abs(new - now[j]))
                now[j] = new
            w[:, active] = now
            active = active[moved >= tol]
        settled[active] = False
        b[live] = w / s[:, None]
    return b, my - mu @ b, settled


def ridge_path(g, alphas):
    """(slopes, intercept) for each penalty (in units of one row) on standardised columns, from one decomposition of the products."""
    p = len(g) - 2
    n = g[p, p]
    if n <= 0:
        return [(np.zeros(p), np.nan)] * len(alphas)
    mu, my = g[:p, p] / n, g[p + 1, p] / n
    c = g[:p, :p] / n - np.outer(mu, mu)
    sd = np.sqrt(np.maximum(np.diag(c), 0))
    live = sd > 1e-9
    values, vectors = np.linalg.eigh(c[np.ix_(live, live)] / np.outer(sd[live], sd[live]))
    side = vectors.T @ ((g[:p, p + 1] / n - mu * my)[live] / sd[live])
    out = []
    for alpha in alphas:
        b = np.zeros(p)
        b[live] = vectors @ (side / (values + alpha / n)) / sd[live]
        out.append((b, my - b @ mu))
    return out


def r2_many(g, sides, b, a):
    """(R2, squared error) of many lines on cross products; ``sides`` as in ``enet_many``."""
    p = len(g) - 2
    w = np.vstack([b, a])
    sse = sides[p + 1] - 2 * (w * sides[:p + 1]).sum(axis=0) + ((g[:p + 1, :p + 1] @ w) * w).sum(axis=0)
    vy = sides[p + 1] - sides[p] ** 2 / g[p, p]
    return np.where(vy > 1e-12, 1 - sse / np.where(vy > 1e-12, vy, 1.0), np.nan), sse


def line_scores(g, b, a):
    """R2, r and mean squared error of a line on cross products."""
    p = len(g) - 2
    n, w = g[p, p], np.append(b, a)
    py, pp, sp = w @ g[:p + 1, p + 1], w @ g[:p + 1, :p + 1] @ w, w @ g[:p + 1, p]
    sy, syy = g[p + 1, p], g[p + 1, p + 1]
    vy, vp = syy - sy * sy / n, pp - sp * sp / n
    sse = syy - 2 * py + pp
    r = (py - sp * sy / n) / np.sqrt(vy * vp) if vy > 1e-12 and vp > 1e-12 else np.nan
    return (1 - sse / vy if vy > 1e-12 else np.nan), r, sse / n
