"""Suffix arrays by grouping suffixes with equal Lyndon prefixes, in linear steps without renaming."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of the suffixes in ascending order; a shorter suffix comes before its extensions.

    First, suffixes grouped by their first symbol are refined: groups are processed from the
    highest down, and the nearest smaller suffix before every member, its previous-smaller
    pointer, has the processed group's prefix appended to its own. Those with equally many
    appended leave their group for a new one right above it. What a group shares when its
    turn comes is its Lyndon prefix. Second, suffixes of a group are ordered as what follows
    that prefix: going through the order from the least suffix on, each emits the suffixes
    whose prefix ends where it begins.
    """
    n = len(text)
    if n < 2:
        return list(range(n))
    kinds = sorted(set(text))
    number = {c: k for k, c in enumerate(kinds)}
    group = [number[c] for c in text]
    members: list[list[int]] = [[] for _ in kinds]
    for i, g in enumerate(group):
        members[g].append(i)
    upper = [*range(1, len(kinds)), -1]
    lower = [-1, *range(len(kinds) - 1)]
    smaller = [0] * n
    near = list(range(-1, n))  # near[i + 1]: i while it isn't processed, else a step to the left
    now = len(kinds) - 1
    while now >= 0:
        here = [i for i in members[now] if group[i] == now]
        members[now] = here
        for i in here:
            near[i + 1] = i - 1
        count: dict[int, int] = {}
        for i in here:
            j = i - 1
            while j >= 0 and near[j + 1] != j:
                j = near[j + 1]
            k = i
            while k > j and k >= 0:  # the way is shortened for later searches
                near[k + 1], k = j, near[k + 1]
            smaller[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        if count:
            by_count: dict[int, list[int]] = {}
            for j, times in count.items():
                by_count.setdefault(times, []).append(j)
            for times in sorted(by_count, reverse=True):
                fresh: dict[int, int] = {}
                for j in by_count[times]:
                    old = group[j]
                    new = fresh.get(old)
                    if new is None:
                        new = fresh[old] = len(members)
                        members.append([])
                        above = upper[old]
                        upper.append(above)
                        lower.append(old)
                        upper[old] = new
                        lower[above] = new
                    group[j] = new
                    members[new].append(j)
        now = lower[now]
    return _emit(n, group, members, upper, lower, smaller)


def _emit(n: int, group: list[int], members: list[list[int]], upper: list[int], lower: list[int], smaller: list[int]) -> list[int]:
    """The second phase; the suffix behind the last symbol is the least of all."""
    first = [0] * len(members)
    g, at = 0, 0
    while lower[g] >= 0:
        g = lower[g]
    while g >= 0:
        first[g] = at
        at += len(members[g])
        g = upper[g]
    order = [0] * n

    def follow(start: int, stop: int) -> None:
        p = start - 1
        while p > stop:
            g = group[p]
            order[first[g]] = p
            first[g] += 1
            p = smaller[p]

    follow(n, -1)
    for k in range(n):
        s = order[k]
        follow(s, smaller[s])
    return order
