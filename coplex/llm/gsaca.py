"""Suffix sorting by Lyndon-prefix groups: linear grouping, then each group's order, without recursion."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of a sequence of non-negative integers.

    Groups start as first symbols and are intervals of the array. From the highest group down, every member points
    to its previous suffix of a smaller group; those that k members point to move, largest k last, into a group of
    their own right above the one they were in, so each group ends as the suffixes of one longest Lyndon prefix. Then
    suffixes are emitted in ascending order: an emitted suffix lets the ones before it, along the pointers, take the
    next free place of their groups."""
    t = [*(x + 1 for x in text), 0]
    n = len(t)
    order = sorted(range(n), key=t.__getitem__)
    place, group, size, before = [0] * n, [0] * n, [0] * n, [-1] * n
    start = 0
    for i, at in enumerate(order):
        if t[at] != t[order[start]]:
            start = i
        place[at], group[at] = i, start
        size[start] += 1
    end = n - 1
    while end >= 0:
        g = group[order[end]]
        members = order[g : end + 1]
        if end > g:
            members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        end = g - 1
        levels: dict[int, list[int]] = {}
        for p, k in pointed.items():
            levels.setdefault(k, []).append(p)
        for k in sorted(levels, reverse=True):
            moved = levels[k]
            for p in moved:
                old = group[p]
                size[old] -= 1
                last, here = old + size[old], place[p]
                other = order[last]
                order[here], order[last] = other, p
                place[other], place[p] = here, last
            for p in moved:
                new = group[p] + size[group[p]]
                group[p] = new
            for p in moved:
                size[group[p]] += 1
    out, done = [0] * n, [False] * n
    out[0] = n - 1
    done[n - 1] = True
    free = list(range(n))
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = before[j]
    return out[1:]


def repeated_starts(parts: list[bytes], length: int) -> list[list[int]]:
    """For each part, in ascending order, the starts of strings of that length that start anywhere else too."""
    data = b"\0".join(parts)
    symbols, first = [], []
    for part in parts:
        first.append(len(symbols))
        symbols += [x + 1 for x in part]
        symbols.append(0)  # ends a part; no byte has it
    ends = [0] * len(symbols)
    for begin, part in zip(first, parts, strict=True):
        ends[begin : begin + len(part) + 1] = [begin + len(part)] * (len(part) + 1)
    owner = [0] * len(symbols)
    for i, (begin, part) in enumerate(zip(first, parts, strict=True)):
        owner[begin : begin + len(part) + 1] = [i] * (len(part) + 1)
    found: list[list[int]] = [[] for _ in parts]
    last, marked = -1, -1
    for at in suffix_array(symbols[:-1]):
        if at + length > ends[at]:
            continue
        if last >= 0 and data[last : last + length] == data[at : at + length]:
            if marked != last:
                found[owner[last]].append(last - first[owner[last]])
            found[owner[at]].append(at - first[owner[at]])
            marked = at
        last = at
    return [sorted(x) for x in found]
