"""Deep-shallow sorting of byte strings with their common prefix lengths.

Plain Python used inside tasks, on the contexts of one anchor. Multikey
quicksort splits the strings eight bytes at a time down to a shallow depth;
strings that still agree there go into a blind trie, which is walked in order.
"""

from __future__ import annotations

SHALLOW = 48   # bytes sorted by multikey quicksort
STEP = 8       # bytes of a key


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix; the first ``at`` bytes are known to agree."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    differ = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Strings by the places where they branch, without the bytes between.

    A node is [depth, branches]; a branch leads to a node or a leaf (a list of
    equal strings' numbers). A new string walks down blindly, is compared with
    one leaf there, and branches off at the first byte that differs. The end
    of a string branches as -1, before every byte.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None

    def byte(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def any_leaf(self, node: list) -> list:
        while isinstance(node[1], dict):
            node = next(iter(node[1].values()))
        return node

    def insert(self, i: int) -> None:
        leaf = [-1, [i]]
        if self.root is None:
            self.root = leaf
            return
        node = self.root
        while isinstance(node[1], dict):
            below = node[1].get(self.byte(i, node[0]))
            if below is None:
                break
            node = below
        other = self.strings[self.any_leaf(node)[1][0]]
        mine = self.strings[i]
        depth = common_prefix(mine, other)
        if depth == len(mine) == len(other):
            self.any_leaf(node)[1].append(i)
            return
        above, node = None, self.root
        while isinstance(node[1], dict) and node[0] < depth:
            above, node = (node, self.byte(i, node[0])), node[1][self.byte(i, node[0])]
        if isinstance(node[1], dict) and node[0] == depth:
            node[1][self.byte(i, depth)] = leaf
            return
        key = other[depth] if depth < len(other) else -1
        split = [depth, {key: node, self.byte(i, depth): leaf}]
        if above is None:
            self.root = split
        else:
            above[0][1][above[1]] = split

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if isinstance(node[1], dict):
                stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
            else:
                out.extend(node[1])
        return out


def deep(strings: list[bytes], part: list[int]) -> list[int]:
    trie = BlindTrie(strings)
    for i in part:
        trie.insert(i)
    return trie.ordered()


def sort(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """The strings' numbers in order of their bytes."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        part, depth = stack.pop()
        if len(part) < 2:
            out.extend(part)
        elif depth >= shallow:
            out.extend(deep(strings, part))
        else:
            key = strings[part[len(part) // 2]][depth:depth + STEP]
            less, equal, more = [], [], []
            for i in part:
                k = strings[i][depth:depth + STEP]
                (equal if k == key else less if k < key else more).append(i)
            stack.append((more, depth))
            # Strings that end within the key are equal as a whole.
            stack.append((equal, depth + STEP if len(key) == STEP else shallow))
            stack.append((less, depth))
    return out


def sort_with_prefixes(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order, and each string's common prefix with the one before (-1: first)."""
    order = sort(strings)
    before = [-1] + [common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]
    return order, before
