"""A compressed radix trie over byte strings that can spill its subtrees to disk."""

import os
import shutil
import struct
import tempfile
from collections.abc import Callable, Iterator

_HEAD = struct.Struct("<qqq")


class _Node:
    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes, owner=None):
        self.label = label
        self.children: dict[int, _Node] = {}
        self.owner = owner


def _shared(a: bytes, b: bytes, start: int) -> int:
    """How many bytes of ``a`` agree with ``b[start:]``, by halving the compared part."""
    low, high = 0, min(len(a), len(b) - start)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[start + low : start + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class RadixTrie:
    """Maps byte strings to owners; ``merge(old, new)`` joins the owners of one string.

    Owners are triples of 64-bit integers. When the labels held in memory exceed ``budget`` bytes,
    the largest subtree below byte ``depth`` goes to a file of its own in a temporary folder, and so
    does what arrives for it later. ``items`` reads each such file into a trie of its own, which
    may spill again, one byte deeper than all its strings agree. ``close`` removes the files.
    """

    def __init__(self, merge: Callable, budget: int, depth: int = 0):
        self.merge, self.budget, self.depth = merge, budget, depth
        self.tops: dict[int, _Node] = {}
        self.held: dict[int, int] = {}
        self.spilled: dict[int, list] = {}
        self.size = 0
        self.strings: dict[int, int] = {}
        self.folder = None

    def insert(self, key: bytes, owner) -> None:
        branch = key[self.depth] if len(key) > self.depth else 256
        if branch in self.spilled:
            self._append(branch, key, owner)
            return
        top = self.tops.get(branch)
        if top is None:
            top = self.tops[branch] = _Node(b"")
            self.held[branch] = self.strings[branch] = 0
        grown = self._insert(top, key, owner)
        self.held[branch] += grown
        self.size += grown
        self.strings[branch] += grown > 0
        # A single string cannot be split, so it is held whatever its size.
        while self.size > self.budget and sum(self.strings.values()) > 1:
            self._spill(max(self.held, key=self.held.get))

    def _insert(self, node: _Node, key: bytes, owner) -> int:
        """Bytes of memory that the string adds; a node counts as 200."""
        at, end = 0, len(key)
        while at < end:
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = _Node(key[at:], owner)
                return end - at + 200
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = _shared(label, key, at)
            fork = _Node(label[:n])
            child.label = label[n:]
            fork.children[child.label[0]] = child
            node.children[key[at]] = fork
            if at + n == end:
                fork.owner = owner
                return 200
            fork.children[key[at + n]] = _Node(key[at + n :], owner)
            return end - at - n + 400
        if node.owner is None:
            node.owner = owner
            return 1
        node.owner = self.merge(node.owner, owner)
        return 0

    @staticmethod
    def _walk(top: _Node) -> Iterator[tuple[bytes, tuple]]:
        stack = [(top, top.label)]
        while stack:
            node, key = stack.pop()
            if node.owner is not None:
                yield key, node.owner
            stack.extend((child, key + child.label) for child in node.children.values())

    def _append(self, branch: int, key: bytes, owner) -> None:
        entry = self.spilled[branch]
        first = entry[1]
        entry[1] = key if first is None else first[: _shared(first, key, 0)]
        entry[0].write(struct.pack("<I", len(key)) + _HEAD.pack(*owner) + key)

    def _spill(self, branch: int) -> None:
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="trie-")
        self.spilled[branch] = [open(os.path.join(self.folder, str(branch)), "w+b"), None]
        for key, owner in self._walk(self.tops.pop(branch)):
            self._append(branch, key, owner)
        self.size -= self.held.pop(branch)
        del self.strings[branch]

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        """Every string with its owner; empties the trie."""
        for branch in list(self.tops):
            yield from self._walk(self.tops.pop(branch))
            self.size -= self.held.pop(branch)
            del self.strings[branch]
        for file, agreed in self.spilled.values():
            file.seek(0)
            below = RadixTrie(self.merge, self.budget, max(self.depth + 1, len(agreed or b"")))
            try:
                while head := file.read(4 + _HEAD.size):
                    key = file.read(struct.unpack_from("<I", head)[0])
                    below.insert(key, _HEAD.unpack_from(head, 4))
                yield from below.items()
            finally:
                below.close()
        self.close()

    def close(self) -> None:
        for file, _ in self.spilled.values():
            file.close()
        self.spilled = {}
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)
            self.folder = None
