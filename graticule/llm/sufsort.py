"""Linear suffix sorting by grouping.

Suffixes start out in groups of one first symbol.  Groups are taken in descending order.  Each suffix of the group
points to the nearest suffix before it that is in a lower group (its previous smaller one).  What is pointed to has the group's
common prefix right after its own, so it moves to a new group right above its old one, the higher the more
suffixes point to it.  In the end a group shares its longest Lyndon prefix, and one pass in ascending
order emits each group's suffixes by the order of what follows them.  No symbol is renamed and nothing recurs.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of a sequence of integers >= 1; a suffix that is a prefix of another is the smaller."""
    n = len(text) + 1
    if n == 1:
        return []
    first: dict[int, list[int]] = {0: [n - 1]}
    for i, c in enumerate(text):
        if c in first:
            first[c].append(i)
        else:
            first[c] = [i]
    # A group is named by where it starts in the suffix array; start_at[e] names the group that ends at e.
    group, members, size, start_at = [0] * n, {}, {}, {}
    at = 0
    for c in sorted(first):
        own = first[c]
        members[at], size[at], start_at[at + len(own) - 1] = own, len(own), at
        for i in own:
            group[i] = at
        at += len(own)
    before = [-1] * n
    end = n - 1
    while end >= 0:
        g = start_at[end]
        end = g - 1
        own = members[g]
        if len(own) != size[g]:
            own = members[g] = [i for i in own if group[i] == g]
        # pointers rise with the suffixes, so equal ones stand together
        runs: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and group[j] > g:
                j = before[j]
            if j >= 0 and group[j] == g:
                j = before[j]
            before[i] = j
            if j >= 0:
                runs[j] = runs.get(j, 0) + 1
        if not runs:
            continue
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in runs.items():
            key = (-times, group[j])
            if key in moved:
                moved[key].append(j)
            else:
                moved[key] = [j]
        for (_, old), js in sorted(moved.items()) if len(moved) > 1 else moved.items():
            count, held = len(js), size[old]
            if count == held:
                continue
            new = old + held - count
            start_at[old + held - 1], start_at[new - 1] = new, old
            size[old], size[new], members[new] = held - count, count, js
            for j in js:
                group[j] = new
    out, slot, placed = [-1] * n, {}, [False] * n
    out[0], placed[n - 1] = n - 1, True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            s = slot.get(g, g)
            out[s], slot[g], placed[j] = j, s + 1, True
            j = before[j]
    return out[1:]


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """How many symbols each suffix of the array shares with the one before it."""
    n = len(text)
    rank, out, h = [0] * n, [0] * n, 0
    for r, i in enumerate(order):
        rank[i] = r
    for i in range(n):
        r = rank[i]
        if r:
            j = order[r - 1]
            m = n - max(i, j)
            while h < m and text[i + h] == text[j + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return out
