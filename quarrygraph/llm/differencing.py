"""Karmarkar-Karp multiway differencing, shared by packing and sharding."""

from __future__ import annotations

import heapq

import numpy as np


def difference(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merge partial partitions until one is left.

    Each item is a vector of ``k`` part sums.  The two with the largest spread are combined, the
    largest part of one with the smallest of the other, until a single partition remains.  Returns
    its sums and, for each item, where each of its parts went: (items, k) positions.
    """
    n, k = len(items), len(items[0])
    # node -> (left, right, order): part j of the node is left's part j plus right's part order[j]
    made: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    heap = []
    for i, v in enumerate(items):
        order = np.argsort(-v, kind="stable")
        heap.append((-float(v.max() - v.min()), i, v[order]))
        made.append((-1, -1, order, order))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heap[0]
        v = a + b[::-1]
        order = np.argsort(-v, kind="stable")
        v = v[order]
        made.append((i, j, order, k - 1 - order))
        heapq.heapreplace(heap, (-float(v[0] - v[-1]), len(made) - 1, v))
    where = np.empty((n, k), np.int64)
    stack = [(len(made) - 1, np.arange(k))]
    while stack:
        node, places = stack.pop()
        left, right, to_left, to_right = made[node]
        # places[j]: final part of the node's j-th part
        if left < 0:
            where[node, to_left] = places
        else:
            put = np.empty(k, np.int64)
            put[to_left] = places
            stack.append((left, put))
            put = np.empty(k, np.int64)
            put[to_right] = places
            stack.append((right, put))
    return heap[0][2], where


def spread_numbers(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of each number and the parts' sums, by differencing single numbers over ``k`` parts.

    Numbers start as partitions with one part filled.  Those are kept short (the filled parts only)
    until a merge needs more room, so memory follows the numbers, not numbers times ``k``.
    """
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(k, np.int64)
    if k == 1:
        return np.zeros(n, np.int64), np.array([sizes.sum()])
    # a partition: spread, tie, sums descending (zeros left out), members by part
    heap = [(-int(s), i, np.array([s], np.int64), [[i]]) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heap[0]
        na, nb = len(a), len(b)
        if na + nb <= k:
            v, members = np.concatenate((a, b)), in_a + in_b
        else:
            # opposite order over k parts: b's largest meets a's smallest (or an empty part)
            v = np.zeros(k, np.int64)
            v[:na] = a
            v[k - nb :] += b[::-1]
            members = in_a + [[] for _ in range(k - na)]
            for j in range(nb):
                at = k - 1 - j
                members[at] = members[at] + in_b[j] if len(members[at]) >= len(in_b[j]) else in_b[j] + members[at]
        order = np.argsort(-v, kind="stable")
        v = v[order]
        members = [members[i] for i in order.tolist()]
        least = v[-1] if len(v) == k else 0
        heapq.heapreplace(heap, (-int(v[0] - least), tie, v, members))
        tie += 1
    part = np.empty(n, np.int64)
    _, _, v, members = heap[0]
    for j, m in enumerate(members):
        part[m] = j
    sums = np.zeros(k, np.int64)
    sums[: len(v)] = v
    return part, sums
