"""Suffix sorting by linear grouping.

The longest Lyndon prefix of a suffix ends where the next smaller suffix begins.
Suffixes are first grouped by it: groups start out as first symbols and are taken
in descending order.  The previous smaller suffixes of a group's members have their
prefix extended by the group's word, once for each member that points to them, so
they leave their own group for a higher place.  When all groups have been taken they
stand in the order of their Lyndon words.

Inside a group the order is that of the suffixes behind the Lyndon word.  Those are
smaller, so one pass over the array in ascending order emits every group: whoever
has the visited suffix as next smaller one takes the next place of its group.  No
step sorts or renames a shorter text.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order; symbols are small non-negative integers."""
    n = len(text)
    if not n:
        return []
    previous, first = _group(text, n)
    return _emit(previous, first, n)


def _group(text: list[int], n: int) -> tuple[list[int], list[int]]:
    """Previous smaller suffix and place of the first member of the final group, for each suffix."""
    ends = [0] * (max(text) + 1)
    for c in text:
        ends[c] += 1
    start = 0
    begin = [0] * len(ends)
    for c, size in enumerate(ends):
        begin[c] = start
        start += size
    free = begin.copy()
    order, place, first, last = [0] * n, [0] * n, [0] * n, [0] * (n + 1)
    for i, c in enumerate(text):
        order[free[c]] = i
        place[i] = free[c]
        free[c] += 1
        first[i] = begin[c]
    for c, size in enumerate(ends):
        if size:
            last[begin[c]] = begin[c] + size  # the end of the group that begins there
    left = list(range(n))  # nearest suffix at or before, not taken yet; compressed on the way
    previous = [-1] * n
    end = n
    while end:
        start = first[order[end - 1]]
        members = order[start:end]
        for i in members:
            left[i] = i - 1
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and left[p] != p:
                p = left[p]
            step = i
            while step > p and left[step] != p:
                left[step], step = p, left[step]
            previous[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        touched = list(pointed)
        if len(pointed) < len(members):  # some were pointed to more than once
            touched.sort(key=pointed.__getitem__, reverse=True)
        i = 0
        while i < len(touched):  # a batch for each count, from the highest down: each goes to what is the upper end of its group by then
            count, upper = pointed[touched[i]], {}
            while i < len(touched) and pointed[touched[i]] == count:
                p = touched[i]
                group = first[p]
                to = upper.get(group, last[group]) - 1
                upper[group] = to
                other, at = order[to], place[p]
                order[to], order[at] = p, other
                place[p], place[other] = to, at
                i += 1
            for group, cut in upper.items():
                if cut > group:  # else the whole rest of the group has this count and keeps its place
                    last[cut], last[group] = last[group], cut
                    for p in order[cut : last[cut]]:
                        first[p] = cut
        end = start
    return previous, first


def _emit(previous: list[int], first: list[int], n: int) -> list[int]:
    order, free = [0] * n, list(range(n))
    visited, stop = n, -1  # the empty suffix is the smallest
    for k in range(n + 1):
        j = visited - 1
        while j != stop and j >= 0:
            group = first[j]
            order[free[group]] = j
            free[group] += 1
            j = previous[j]
        if k < n:
            visited = order[k]
            stop = previous[visited]
    return order
