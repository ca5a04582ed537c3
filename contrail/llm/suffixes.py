"""A suffix array by linear grouping, without recursion and without renaming.

The Lyndon prefix of a suffix is its longest prefix that is a Lyndon word; suffixes
that share it form a group, and groups stand in the order of their words. First the
groups are found. All suffixes start out grouped by their first byte, and groups are
taken from the greatest down. When a group is taken its word is final. Each of its
members hangs below the nearest position before it that no taken group holds, which
is its previous smaller suffix; that suffix's word grows by the group's word, once for
each member below it, and it moves to a new group just above the rest of its old one.
Then the suffixes are emitted in order: behind its word, a member goes on with the next
smaller suffix, so every emitted suffix puts those that go on with it into the next
free places of their groups.
"""

from __future__ import annotations


def lyndon_groups(text: bytes) -> tuple[list[list[int]], list[int]]:
    """Groups in ascending order, and the length of each group's word."""
    n = len(text)
    by_byte: dict[int, list[int]] = {}
    for place, value in enumerate(text):
        if value in by_byte:
            by_byte[value].append(place)
        else:
            by_byte[value] = [place]
    members = [by_byte[value] for value in sorted(by_byte)]
    count = len(members)
    group = [0] * n
    for number, places in enumerate(members):
        for place in places:
            group[place] = number
    length, below, above = [1] * count, list(range(-1, count - 1)), [*range(1, count), -1]
    moved = [False] * count
    # place p stands at p + 1; a taken place points before itself, 0 is "none"
    free = list(range(n + 1))
    groups, lengths = [], []
    current = count - 1
    while current >= 0:
        own = members[current]
        if moved[current]:
            own = [place for place in own if group[place] == current]
        members[current] = []
        if own:
            groups.append(own)
            size = length[current]
            lengths.append(size)
            for place in own:
                free[place + 1] = place
            hung: dict[int, int] = {}
            for place in own:
                at = place
                while free[at] != at:
                    free[at] = free[free[at]]
                    at = free[at]
                free[place + 1] = at
                if at:
                    hung[at] = hung.get(at, 0) + 1
            splits: dict[tuple[int, int], int] = {}
            if len(hung) > 1:
                for old, times in sorted({(group[at - 1], times) for at, times in hung.items()}, reverse=True):
                    splits[old, times] = 0
            else:
                for at, times in hung.items():
                    splits[group[at - 1], times] = 0
            # more copies of the word stand higher: each new group goes right above the old one, highest first
            for old, times in splits:
                new = len(members)
                splits[old, times] = new
                members.append([])
                moved.append(False)
                length.append(length[old] + times * size)
                over = above[old]
                below.append(old)
                above.append(over)
                above[old] = new
                below[over] = new
                moved[old] = True
            for at, times in hung.items():
                new = splits[group[at - 1], times]
                members[new].append(at - 1)
                group[at - 1] = new
        current = below[current]
    groups.reverse()
    lengths.reverse()
    return groups, lengths


def suffix_array(text: bytes) -> list[int]:
    """Start places of all suffixes in ascending order."""
    n = len(text)
    groups, lengths = lyndon_groups(text)
    slot_of, goes_on = [0] * n, [-1] * (n + 1)  # goes_on: first of those that go on with a suffix
    beside = [-1] * n
    slots, start = [], 0
    for number, (own, size) in enumerate(zip(groups, lengths)):
        slots.append(start)
        start += len(own)
        for place in own:
            slot_of[place] = number
            beside[place] = goes_on[place + size]
            goes_on[place + size] = place
    order = [0] * n
    suffix = n
    for emitted in range(n + 1):
        place = goes_on[suffix]
        while place >= 0:
            number = slot_of[place]
            order[slots[number]] = place
            slots[number] += 1
            place = beside[place]
        if emitted < n:
            suffix = order[emitted]
    return order
