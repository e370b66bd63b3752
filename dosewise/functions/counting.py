"""Counting inside one task, on arrays."""

import numpy as np


def inversions(values, weights):
    """Sum of w[i] * w[j] over i < j with values[i] > values[j], in n log n.

    The values are split by their binary digits from the highest: among values with equal higher digits, those with digit 1
    that stand before one with digit 0 are inverted with it; a stable sort on the digits seen so far keeps the order.
    """
    codes = np.unique(np.asarray(values), return_inverse=True)[1].astype(np.int64)
    weights = np.asarray(weights, dtype=np.int64)
    total = 0
    for bit in range(int(codes.max(initial=0)).bit_length() - 1, -1, -1):
        head, one = codes >> (bit + 1), (codes >> bit) & 1
        before = np.cumsum(weights * one) - weights * one
        starts = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
        before = before - np.repeat(before[starts], np.diff(np.r_[starts, len(head)]))
        total += int((weights * (1 - one) * before).sum())
        order = np.argsort(codes >> bit, kind="stable")
        codes, weights = codes[order], weights[order]
    return total
