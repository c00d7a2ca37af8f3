"""Suffix arrays by linear grouping construction.

Phase 1 sorts suffixes into groups by their Lyndon prefix: groups are processed in descending
order; each member points to the nearest earlier suffix of a smaller group, and the suffixes
pointed at move behind the rest of their group, those with more pointers further back. Phase 2
walks the sorted suffixes and emits each group's members in order along the same pointers, so
no text is renamed and nothing recurses.
"""

from __future__ import annotations

from collections import Counter, defaultdict


def group_by_lyndon_prefix(text: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix the first rank of its group, and its previous smaller pointer (-1: none)."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n
    group = [0] * n
    start = 0
    for k, i in enumerate(order):
        if k and text[i] != text[order[k - 1]]:
            start = k
        place[i], group[i] = k, start
    ends = dict.fromkeys(group, 0)  # one past the last member, by first rank
    for k, i in enumerate(order):
        ends[group[i]] = k + 1
    previous = [-1] * n
    stop = n
    while stop:
        first = group[order[stop - 1]]
        pointed: Counter[int] = Counter()
        for i in sorted(order[first:stop]):
            j = i - 1
            while j >= 0 and group[j] >= first:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointed[j] += 1
        by_count: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for j, count in pointed.items():
            by_count[count][group[j]].append(j)
        for count in sorted(by_count, reverse=True):
            for old, moved in by_count[count].items():
                end = ends[old]
                cut = end - len(moved)
                if cut == old:
                    continue
                for k, j in zip(range(end - 1, cut - 1, -1), moved, strict=True):
                    other, at = order[k], place[j]
                    order[at], place[other] = other, at
                    order[k], place[j] = j, k
                for j in moved:
                    group[j] = cut
                ends[cut], ends[old] = end, cut
        stop = first
    return group, previous


def suffix_array(text: list[int]) -> list[int]:
    """Sorted suffixes of ``text``, whose last symbol must be smaller than all others."""
    n = len(text)
    if n < 2:
        return list(range(n))
    group, previous = group_by_lyndon_prefix(text)
    head = {g: g for g in group}
    placed = [False] * n
    out = [0] * n
    out[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[head[g]] = j
            head[g] += 1
            placed[j] = True
            j = previous[j]
    return out
