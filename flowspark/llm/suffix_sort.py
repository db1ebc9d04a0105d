"""Deep-shallow sorting of many short suffixes: multikey quicksort to a shallow depth, blind tries below it."""

from __future__ import annotations

import numpy as np

WORD_BYTES = 8


def _words(block: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian 64-bit characters, so that order of numbers is order of bytes."""
    return block.reshape(len(block), -1, WORD_BYTES).view(">u8")[:, :, 0].astype(np.uint64)


def _quick(keys: np.ndarray, order: np.ndarray, runs: list[tuple[int, int]]) -> None:
    """Multikey quicksort of ``order`` by the rows of ``keys``; appends the runs equal in all of them.

    Three-way partition around a median character; the middle part goes on with the next character.
    """
    stack = [(0, len(order), 0)]
    while stack:
        first, last, depth = stack.pop()
        if last - first < 2:
            continue
        if depth == keys.shape[1]:
            runs.append((first, last))
            continue
        rows = order[first:last]
        own = keys[rows, depth]
        if last - first <= 1 << 16:  # few enough: all characters of this depth at once
            by = np.argsort(own, kind="stable")
            order[first:last] = rows[by]
            edges = np.flatnonzero(np.diff(own[by])) + 1
            cuts = np.concatenate([[0], edges, [last - first]])
            for a, b in zip(cuts[:-1][np.diff(cuts) > 1], cuts[1:][np.diff(cuts) > 1], strict=True):
                stack.append((first + int(a), first + int(b), depth + 1))
            continue
        pivot = np.sort(own[:: max(1, len(own) // 1023)])[len(own[:: max(1, len(own) // 1023)]) // 2]
        low, same = rows[own < pivot], rows[own == pivot]
        order[first:last] = np.concatenate([low, same, rows[own > pivot]])
        a, b = first + len(low), first + len(low) + len(same)
        stack += [(first, a, depth), (a, b, depth + 1), (b, last, depth)]


class BlindTrie:
    """A trie of branching depths only: strings are compared in full once per insertion."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None  # [depth, {byte: child}] or an int leaf list [-1, rows]

    @staticmethod
    def _common(a: bytes, b: bytes) -> int:
        if a == b:
            return len(a)
        low, high = 0, min(len(a), len(b))
        while low < high:
            middle = (low + high + 1) // 2
            if a[:middle] == b[:middle]:
                low = middle
            else:
                high = middle - 1
        return low

    @staticmethod
    def _byte(text: bytes, depth: int) -> int:
        return text[depth] if depth < len(text) else -1

    def insert(self, row: int) -> None:
        text = self.strings[row]
        if self.root is None:
            self.root = [-1, [row]]
            return
        node = self.root
        while node[0] >= 0:  # blind: only the branching characters are looked at
            node = node[1].get(self._byte(text, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        if text == other:
            node[1].append(row)
            return
        depth = self._common(text, other)
        above, node = None, self.root
        while node[0] >= 0 and node[0] < depth:
            above, node = node, node[1][self._byte(text, node[0])]
        if node[0] == depth:
            node[1][self._byte(text, depth)] = [-1, [row]]
            return
        split = [depth, {self._byte(other, depth): node, self._byte(text, depth): [-1, [row]]}]
        if above is None:
            self.root = split
        else:
            above[1][self._byte(text, above[0])] = split

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                out += node[1]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def suffix_order(groups: np.ndarray, block: np.ndarray, lengths: np.ndarray, shallow: int = 96) -> np.ndarray:
    """Order of rows by (group, bytes).  ``block`` has rows padded with zeros to a multiple of 8 bytes.

    The first ``shallow`` bytes are sorted by multikey quicksort; rows that agree in all of them are
    put in order by a blind trie over their remaining bytes.
    """
    shallow = min(shallow, block.shape[1])
    keys = np.concatenate([groups.astype(np.uint64)[:, None], _words(block[:, :shallow])], axis=1)
    order = np.arange(len(block))
    runs: list[tuple[int, int]] = []
    _quick(keys, order, runs)
    for first, last in runs:
        rows = order[first:last]
        rest = [block[r, shallow : max(shallow, lengths[r])].tobytes() for r in rows]
        head = np.minimum(lengths[rows], shallow)  # shorter than the shallow depth: zeros of padding are no bytes
        if len(set(rest)) == 1 and (head == head[0]).all():
            continue
        own = {c: [] for c in sorted(set(head.tolist()))}
        for i, c in enumerate(head.tolist()):
            own[c].append(i)
        placed: list[int] = []
        for chosen in own.values():
            trie = BlindTrie(rest)
            for i in chosen:
                trie.insert(i)
            placed += trie.ordered()
        order[first:last] = rows[placed]
    return order


def common_prefixes(groups: np.ndarray, block: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row in order and the one before it; -1 across groups."""
    out = np.full(len(order), -1, dtype=np.int64)
    for at in range(1, len(order), 1 << 16):
        now, before = order[at : at + (1 << 16)], order[at - 1 : at - 1 + min(1 << 16, len(order) - at)]
        differ = block[now] != block[before]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), block.shape[1])
        first = np.minimum(first, np.minimum(lengths[now], lengths[before]))
        out[at : at + len(now)] = np.where(groups[now] == groups[before], first, -1)
    return out
