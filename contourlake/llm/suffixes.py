"""Suffix arrays by linear Lyndon grouping.

The suffixes of a text fall into groups by their Lyndon prefix (the longest prefix that is a Lyndon word).  In the tree of
previous-smaller pointers a suffix's Lyndon prefix is its first symbol followed by the Lyndon prefixes of its children,
largest child first.  ``groups`` follows these pointers once and names every such sequence by a path in a trie.
``descending`` then ranks the trie's words from the largest down: a word that has been ranked opens the paths that it
extends, and these are smaller, so every path is met in order and nothing is renamed or sorted again.  ``emit`` lists the
suffixes in order: the one after a suffix's Lyndon prefix is smaller, so when a suffix is reached, those whose prefix it
follows take the next free places of their groups.
"""

from __future__ import annotations

import numpy as np


def groups(text: bytes, codes: list[int], ends: list[int], alphabet: int) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """Group of every suffix, the next smaller suffix, and the trie edges.

    ``text`` holds strings over the symbols 1..alphabet (four bytes each, the highest first, so that slices compare like
    their symbols; ``codes`` the same as numbers), each closed by one symbol at the positions ``ends`` (ascending), which
    is smaller than anything whatever its value.  Trie nodes 1..alphabet are single symbols; node alphabet + k is made by edge k - 1 = (node, word).  A closing symbol has
    group 0.
    """
    n = len(codes)
    group, following = [0] * n, [0] * n
    edges: list[tuple[int, int]] = []
    known: dict[int, int] = {}
    get = known.get
    start = 0
    for close in ends:
        following[close] = close + 1
        i = close - 1
        while i >= start:
            node = symbol = codes[i]
            end = i + 1
            # the stack of smaller suffixes is the chain of next smaller positions
            while end != close:
                top = codes[end]
                if top < symbol or (top == symbol and text[4 * i : 4 * end] >= text[4 * end : 4 * following[end]]):
                    break
                word = group[end]
                key = node << 32 | word
                child = get(key)
                if child is None:
                    edges.append((node, word))
                    child = alphabet + len(edges)
                    known[key] = child
                node, end = child, following[end]
            group[i], following[i] = node, end
            i -= 1
        start = close + 1
    return group, following, edges


def descending(edges: list[tuple[int, int]], alphabet: int) -> np.ndarray:
    """Rank of every trie node (0 for unused ones): larger words have larger ranks."""
    total = alphabet + 1 + len(edges)
    extends: dict[int, list[tuple[int, int]]] = {}
    for k, (node, word) in enumerate(edges):
        extends.setdefault(word, []).append((node, alphabet + 1 + k))
    waiting: dict[int, list[int]] = {}
    rank = np.zeros(total, np.int64)
    current = total
    for root in range(alphabet, 0, -1):
        # depth first, largest child first; a child list may grow while its node is open, by smaller words only
        path = [(root, 0)]
        while path:
            node, at = path.pop()
            children = waiting.get(node)
            if children is not None and at < len(children):
                path.append((node, at + 1))
                path.append((children[at], 0))
                continue
            rank[node] = current
            current -= 1
            for parent, child in extends.get(node, ()):
                waiting.setdefault(parent, []).append(child)
    return rank


def emit(group: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Suffix order from ranked groups (0: closing bytes, listed first in text order)."""
    n = len(group)
    counts = np.bincount(group)
    free = (np.cumsum(counts) - counts).tolist()
    # lists of the suffixes that wait for the same one: head of each list, and the next in it
    waiting = np.flatnonzero(group)
    waiting = waiting[np.argsort(following[waiting], kind="stable")]
    target = following[waiting]
    same = target[1:] == target[:-1]
    link, head = np.full(n, -1), np.full(n + 1, -1)
    link[waiting[:-1][same]] = waiting[1:][same]
    opens = np.flatnonzero(np.concatenate([[True], ~same])) if len(waiting) else waiting
    head[target[opens]] = waiting[opens]
    heads, links, of = head.tolist(), link.tolist(), group.tolist()
    closing = np.flatnonzero(group == 0).tolist()
    order = closing + [0] * (n - len(closing))
    for x in order:  # grows ahead of the loop
        j = heads[x]
        while j >= 0:
            g = of[j]
            at = free[g]
            order[at] = j
            free[g] = at + 1
            j = links[j]
    return np.array(order, np.int64)


def suffix_array(codes: np.ndarray, ends: np.ndarray, alphabet: int) -> np.ndarray:
    """Positions in the order of their suffixes; suffixes that are equal up to their closing symbols are neighbours.

    ``codes``: symbols 1..alphabet (below 2^32), and anything at the closing positions ``ends``.
    """
    if not len(codes):
        return np.zeros(0, np.int64)
    numbers = codes.astype(">u4")
    group, following, edges = groups(numbers.tobytes(), numbers.tolist(), ends.tolist(), alphabet)
    rank = descending(edges, alphabet)
    return emit(rank[np.array(group, np.int64)], np.array(following, np.int64))
