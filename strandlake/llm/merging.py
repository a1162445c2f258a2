"""Byte-pair merging with a heap and a linked list, shared by the counter and the encoder."""

from __future__ import annotations

import heapq
from collections.abc import Callable


def merged(parts: list, rank: Callable) -> list:
    """What is left of the symbols `parts` (changed in place) when the adjacent pair of least rank, the leftmost on ties, is merged
    again and again until no pair has a rank. rank((left, right)) is None for a pair that does not merge.

    The heap holds (rank, place of the left symbol); an entry whose pair has been merged since is passed over when it comes up.
    """
    n = len(parts)
    heap = [(r, i) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
    if not heap:
        return parts
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        r, i = pop(heap)
        left = parts[i]
        if left is None or (j := after[i]) >= n or rank((left, parts[j])) != r:
            continue
        parts[i] = joined = left + parts[j]
        parts[j] = None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank((joined, parts[k]))) is not None:
                push(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := rank((parts[h], joined))) is not None:
            push(heap, (r, h))
    return [p for p in parts if p is not None]
