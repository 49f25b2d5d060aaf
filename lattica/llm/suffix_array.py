"""Linear grouping construction of the suffix array (Baier 2016), and longest common prefixes."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(s: Sequence[int]) -> list[int]:
    """Sorted suffix starts of ``s``, whose last symbol must be its single least.

    Suffixes are grouped by their Lyndon prefixes: groups are taken in
    descending order; each suffix of a group finds its previous suffix in a
    lower group, and those are split by how often they were found, so that they
    move to higher groups next to their own.  A group is an interval of places
    and is named by where it starts, so a split renames only what moves.  Then
    each group's order comes from the sorted suffixes before it.
    """
    n = len(s)
    if n == 0:
        return []
    place = sorted(range(n), key=s.__getitem__)
    where = [0] * n
    group = [0] * n
    size = [0] * n
    start = 0
    for at, i in enumerate(place):
        if at and s[i] != s[place[at - 1]]:
            start = at
        where[i] = at
        group[i] = start
        size[start] += 1
    prev = [-1] * n
    top = n
    while top:
        g = group[place[top - 1]]
        members = place[g:top]
        if len(members) > 1:
            members.sort()
        found: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                found[j] = found.get(j, 0) + 1
        top = g
        if len(found) == 1:
            (j,) = found
            rounds = ((j,),)
        elif max(found.values(), default=0) <= 1:
            rounds = (found,) if found else ()
        else:
            by_count: dict[int, list[int]] = {}
            for j, c in found.items():
                by_count.setdefault(c, []).append(j)
            rounds = [by_count[c] for c in sorted(by_count, reverse=True)]
        for part in rounds:
            moved: dict[int, int] = {}
            for j in part:  # to the end of its group's interval
                h = group[j]
                moved[h] = k = moved.get(h, 0) + 1
                to = h + size[h] - k
                other, was = place[to], where[j]
                place[to], place[was] = j, other
                where[j], where[other] = to, was
            for h, k in moved.items():
                left = size[h] - k
                if left:
                    new = h + left
                    size[h], size[new] = left, k
                    for to in range(new, new + k):
                        group[place[to]] = new
    out = [-1] * n
    free = list(range(n))
    done = bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    free[group[n - 1]] += 1
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = prev[j]
    return out


def common_prefixes(s: Sequence[int], sa: Sequence[int]) -> list[int]:
    """Symbols that each suffix of ``sa`` shares with the one before it."""
    n = len(s)
    rank = [0] * n
    for at, i in enumerate(sa):
        rank[i] = at
    out, h = [0] * n, 0
    for i in range(n):
        r = rank[i]
        if r:
            j = sa[r - 1]
            while i + h < n and j + h < n and s[i + h] == s[j + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return out
