"""Linear suffix sorting by grouping.

Phase 1 starts with the suffixes grouped by first symbol and takes the groups in descending order. Each member points to
the nearest place to its left that lies in a lower group; places that k members point to leave their group together for a
new one right behind it (more pointers: further behind). In the end a group holds the suffixes of one Lyndon prefix.
Phase 2 emits the order: going through the sorted suffixes, the place before each, and those its pointers lead to, are
next in their groups. No symbol is ever renamed, nothing recurses.
"""

from __future__ import annotations

from itertools import groupby


def suffix_array(symbols: list[int]) -> list[int]:
    """Order of all suffixes of a list of integers, a shorter suffix before those that continue it."""
    n = len(symbols)
    if n < 2:
        return list(range(n))
    order = sorted(range(n), key=symbols.__getitem__)
    # place n is the empty suffix: a group of its own, below all others
    members: list[list[int]] = [[n]]
    group = [0] * (n + 1)
    for _, same in groupby(order, key=symbols.__getitem__):
        own = list(same)
        for i in own:
            group[i] = len(members)
        members.append(own)
    lower, upper = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    left = list(range(-1, n))  # left[i + 1]: a place not yet done at i or before it, followed like a linked forest
    pointer = [-1] * (n + 1)
    now = len(members) - 1
    while now > 0:
        own = [i for i in members[now] if group[i] == now]
        members[now] = own
        for i in own:
            left[i + 1] = i - 1
        hits: dict[int, int] = {}
        for i in own:
            at = i - 1
            while at >= 0 and left[at + 1] != at:
                left[at + 1] = step = left[left[at + 1] + 1] if left[at + 1] >= 0 else -1
                at = step
            pointer[i] = at
            if at >= 0:
                hits[at] = hits.get(at, 0) + 1
        if hits:
            moved: dict[tuple[int, int], list[int]] = {}
            for place, count in hits.items():
                key = (group[place], -count)
                if key in moved:
                    moved[key].append(place)
                else:
                    moved[key] = [place]
            for (old, _), places in sorted(moved.items()) if len(moved) > 1 else moved.items():
                new = len(members)
                members.append(places)
                above = upper[old]
                lower.append(old)
                upper.append(above)
                upper[old] = new
                lower[above] = new
                for place in places:
                    group[place] = new
        now = lower[now]
    # phase 2
    start, at, total = [0] * len(members), 0, 0
    while at >= 0:
        start[at] = total
        total += len(members[at])
        at = upper[at]
    out, placed = [-1] * (n + 1), [False] * (n + 1)
    out[0] = n
    for k in range(n + 1):
        at = out[k] - 1
        while at >= 0 and not placed[at]:
            placed[at] = True
            own_group = group[at]
            out[start[own_group]] = at
            start[own_group] += 1
            at = pointer[at]
    return out[1:]
