"""Deep-shallow sorting of suffixes up to a depth.

Shallow: multikey quicksort, some bytes at a time. Suffixes that agree so far are split by their next
bytes, all groups at once, down to a shallow depth. What still agrees there has a long common
prefix, on which comparisons byte by byte would be wasted; these groups go to blind tries. A blind trie
keeps branching bytes and the depths they stand at, no strings: a suffix is led down by its bytes at
those depths, compared once with the leaf it comes to, and hung in at the byte where they part.
"""

from __future__ import annotations

import numpy as np


def _eights(text: np.ndarray) -> np.ndarray:
    """For every position its eight bytes as one big-endian number (zeros beyond the end)."""
    raw, out = text.tobytes() + bytes(16), np.empty(len(text) + 8, np.uint64)
    for j in range(8):
        out[j::8] = np.frombuffer(raw, ">u8", len(out[j::8]), j)
    return out


def blind_trie_order(strings: list[bytes]) -> list[list[int]]:
    """Numbers of ``strings`` (all of one length) in order, equal ones together: these share a leaf."""
    leaves: dict[bytes, list[int]] = {}
    for i, s in enumerate(strings):
        leaves.setdefault(s, []).append(i)
    if len(leaves) == 1:
        return list(leaves.values())
    width, root = len(strings[0]), None  # a node is [depth, {byte: node}], or a leaf: the numbers of equal strings
    for s, leaf in leaves.items():
        if root is None:
            root = leaf
            continue
        node = root
        while isinstance(node[-1], dict):  # blindly down, to any leaf where no byte fits
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = strings[node[0]]
        apart = int.from_bytes(s) ^ int.from_bytes(other)
        same = width - (apart.bit_length() + 7) // 8
        above, node = None, root
        while isinstance(node[-1], dict) and node[0] < same:
            above, node = node, node[1][s[node[0]]]
        if isinstance(node[-1], dict) and node[0] == same:
            node[1][s[same]] = leaf
            continue
        fork = [same, {other[same]: node, s[same]: leaf}]
        if above is None:
            root = fork
        else:
            above[1][s[above[0]]] = fork
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node[-1], dict):
            todo.extend(node[1][c] for c in sorted(node[1], reverse=True))
        else:
            out.append(node)
    return out


def sorted_suffixes(text: np.ndarray, starts: np.ndarray, depth: int, shallow: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(order, fresh): numbers of the suffixes of ``text`` at ``starts`` in order of their first ``depth``
    bytes (which must lie in ``text``); ``fresh`` tells where one differs there from the one before it."""
    n, shallow = len(starts), min(shallow, depth)
    order, fresh = np.arange(n), np.zeros(n, bool)
    fresh[:1] = True
    if n < 2:
        return order, fresh
    eights = _eights(text)

    def character(suffixes: np.ndarray, at: int, end: int, most: int = 8) -> np.ndarray:
        """The next ``most`` bytes, or as many as there are up to ``end``, as a number."""
        return eights[starts[suffixes] + at] >> np.uint64(8 * (8 - min(most, end - at)))

    open_, at = np.arange(n), 0  # places in ``order`` whose group has more than one suffix
    while at < shallow and len(open_):
        group = np.cumsum(fresh[open_]) - 1
        most = (64 - int(group[-1]).bit_length()) // 8  # bytes that fit into a number beside the group's
        key = character(order[open_], at, shallow, most)
        if at:
            key |= group.astype(np.uint64) << np.uint64(8 * most)
        by = np.argsort(key)
        order[open_], key = order[open_][by], key[by]
        fresh[open_[1:]] |= key[1:] != key[:-1]
        alone = fresh & np.append(fresh[1:], True)
        open_, at = np.flatnonzero(~alone), at + most
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, n))
    width = depth - shallow
    if not width or (size == 1).all():
        return order, fresh
    two = begin[size == 2]  # two suffixes need no trie: one comparison
    undecided = two
    for at in range(shallow, depth, 8):
        a, b = (character(order[undecided + i], at, depth) for i in (0, 1))
        swap = undecided[a > b]
        order[swap], order[swap + 1] = order[swap + 1], order[swap]
        fresh[undecided[a != b] + 1] = True
        undecided = undecided[a == b]
    raw = text.tobytes()
    for lo, m in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
        group = order[lo : lo + m]
        leaves = blind_trie_order([raw[s + shallow : s + depth] for s in starts[group].tolist()])
        order[lo : lo + m] = group[[i for leaf in leaves for i in leaf]]
        at = lo
        for leaf in leaves:
            fresh[at] = True
            at += len(leaf)
    return order, fresh
