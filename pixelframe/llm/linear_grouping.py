"""The first phase of suffix sorting by linear grouping, which also yields the Lyndon array.

Suffixes start in groups by their first symbol; from the highest group down, each suffix's previous suffix of
a lower group is moved behind its own group, by how many such suffixes it precedes, so that groups become
those of equal longest Lyndon prefixes. No suffix is ever renamed.
"""

from __future__ import annotations

from collections import Counter, defaultdict


def lyndon_lengths(symbols: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each place; symbols are at least 0, the end is less than all.

    What precedes a group's suffixes takes on the group's prefix, once for each of them; so a group's prefix is
    known by its length alone.
    """
    n = len(symbols) + 1
    codes = [c + 1 for c in symbols] + [0]
    order = sorted(range(n), key=codes.__getitem__)
    place, start, size, width = [0] * n, [0] * n, [0] * n, [1] * n
    head = 0
    for k, s in enumerate(order):
        if k and codes[order[k - 1]] != codes[s]:
            head = k
        place[s] = k
        start[s] = head
        size[head] += 1
    before = [-1] * n
    high = n
    while high:
        low = start[order[high - 1]]
        wide = width[low]
        if high - low == 1:
            s = order[low]
            j = s - 1
            while j >= 0 and start[j] >= low:
                j = before[j]
            before[s] = j
            if j >= 0:
                g = start[j]
                if size[g] == 1:
                    width[g] += wide
                else:
                    size[g] -= 1
                    at, end = place[j], g + size[g]
                    other = order[end]
                    order[at], order[end] = other, j
                    place[other], place[j] = at, end
                    start[j], size[end], width[end] = end, 1, width[g] + wide
            high = low
            continue
        chained: Counter = Counter()
        for s in sorted(order[low:high]):
            j = s - 1
            while j >= 0 and start[j] >= low:
                j = before[j]
            before[s] = j
            if j >= 0:
                chained[j] += 1
        levels = defaultdict(list)
        for j, k in chained.items():
            levels[k].append(j)
        for k in sorted(levels, reverse=True):
            moved: dict[int, int] = {}
            for j in levels[k]:
                g = start[j]
                moved[g] = m = moved.get(g, 0) + 1
                at, end = place[j], g + size[g] - m
                other = order[end]
                order[at], order[end] = other, j
                place[other], place[j] = at, end
            for g, m in moved.items():
                if m == size[g]:
                    width[g] += k * wide
                else:
                    size[g] -= m
                    new = g + size[g]
                    size[new], width[new] = m, width[g] + k * wide
                    for at in range(new, new + m):
                        start[order[at]] = new
        high = low
    return [width[start[i]] for i in range(n - 1)]
