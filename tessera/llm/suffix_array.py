"""Suffix arrays in linear time by grouping (no recursion, no renaming).

Suffixes are grouped by the Lyndon words they begin with.  Groups are taken in
descending order: every suffix of a group points to the nearest suffix to its left
that stands in a lower group, and the suffixes pointed at move, those with the most
pointers last, into groups of their own right behind the rest of their old ones.
What results is sorted by Lyndon prefix.  A walk over the array from its smallest
entry then writes each group in order: the suffix before an entry, and those its
pointers chain to, take the next free places of their groups.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of all suffixes of ``text`` in ascending order; any integers may be its symbols."""
    n = len(text)
    if n < 2:
        return list(range(n))
    # One sentinel below all symbols ends the text.
    starts: dict[int, int] = {}
    counts: dict[int, int] = {}
    for c in text:
        counts[c] = counts.get(c, 0) + 1
    at = 1
    for c in sorted(counts):
        starts[c] = at
        at += counts[c]
    size = n + 1
    order = [0] * size  # suffixes by group
    place = [0] * size  # the place of each suffix in ``order``
    group = [0] * size  # the first place of each suffix's group
    ends = [0] * (size + 1)  # by a group's first place: the place behind its last
    order[0] = place[n] = n
    place[n] = 0
    ends[0] = 1
    free = dict(starts)
    for i, c in enumerate(text):
        k = free[c]
        free[c] = k + 1
        order[k] = i
        place[i] = k
        group[i] = starts[c]
    for c, k in starts.items():
        ends[k] = k + counts[c]

    previous = [-1] * size
    leap = [-1] * size  # like ``previous``, but moved on as groups get lower
    top = size
    while top > 1:
        low = group[order[top - 1]]
        members = order[low:top]
        if len(members) > 1:
            members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            j = i - 1
            if j >= 0 and group[j] >= low:
                j = leap[j]
                while j >= 0 and group[j] >= low:
                    j = leap[j]
                # Later walks over the same stretch start where this one ended.
                k = i - 1
                while k > j:
                    leap[k], k = j, leap[k]
            previous[i] = leap[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if pointed:
            if len(pointed) == len(members) or max(pointed.values()) == 1:
                layers = [pointed]
            else:
                by: dict[int, list[int]] = {}
                for j, c in pointed.items():
                    by.setdefault(c, []).append(j)
                layers = [by[c] for c in sorted(by, reverse=True)]
            for layer in layers:
                moved: dict[int, int] = {}
                for j in layer:
                    # The suffix changes places with the last one of its group that has not moved.
                    g = group[j]
                    end = moved.get(g)
                    end = (ends[g] if end is None else end) - 1
                    moved[g] = end
                    here = place[j]
                    if here != end:
                        other = order[end]
                        order[here] = other
                        place[other] = here
                        order[end] = j
                        place[j] = end
                for g, begin in moved.items():
                    if begin != g:  # else the whole group moved, and stays one
                        end = ends[g]
                        ends[begin] = end
                        ends[g] = begin
                        for k in range(begin, end):
                            group[order[k]] = begin
        top = low

    # The second phase: groups are written in order.
    out = [0] * size
    out[0] = n
    fill = list(range(size + 1))  # the next free place, by a group's first place
    done = bytearray(size)
    done[n] = 1
    for k in range(size):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            at = fill[g]
            fill[g] = at + 1
            out[at] = j
            done[j] = 1
            j = previous[j]
    return out[1:]
