"""An adaptive radix tree over byte strings: four node layouts that grow, and compressed paths.

Built by a task from its own sorted keys; see `prefix_trie`.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

# How many children each layout holds.
SMALL, MEDIUM, INDEXED = 4, 16, 48


class Sorted:
    """Up to `room` children in the order of their bytes (4, then 16)."""

    __slots__ = ("room", "bytes", "nodes")

    def __init__(self, room: int = SMALL, bytes_: list[int] | None = None, nodes: list | None = None):
        self.room, self.bytes, self.nodes = room, bytes_ or [], nodes or []

    def find(self, byte: int) -> Node | None:
        i = bisect_left(self.bytes, byte)
        return self.nodes[i] if i < len(self.bytes) and self.bytes[i] == byte else None

    def put(self, byte: int, node: Node) -> Sorted | Indexed:
        """Set the child of a byte; the layout that holds it from now on."""
        i = bisect_left(self.bytes, byte)
        if i < len(self.bytes) and self.bytes[i] == byte:
            self.nodes[i] = node
            return self
        if len(self.bytes) == self.room:
            return (Sorted(MEDIUM, self.bytes, self.nodes) if self.room == SMALL else Indexed(self)).put(byte, node)
        self.bytes.insert(i, byte)
        self.nodes.insert(i, node)
        return self

    def children(self) -> Iterator[Node]:
        return iter(self.nodes)


class Indexed:
    """Up to 48 children in the order they came, with a place for each byte."""

    __slots__ = ("places", "nodes")

    def __init__(self, grown: Sorted):
        self.places, self.nodes = bytearray(256), list(grown.nodes)
        for place, byte in enumerate(grown.bytes, 1):
            self.places[byte] = place

    def find(self, byte: int) -> Node | None:
        place = self.places[byte]
        return self.nodes[place - 1] if place else None

    def put(self, byte: int, node: Node) -> Indexed | Full:
        if place := self.places[byte]:
            self.nodes[place - 1] = node
            return self
        if len(self.nodes) == INDEXED:
            return Full(self).put(byte, node)
        self.nodes.append(node)
        self.places[byte] = len(self.nodes)
        return self

    def children(self) -> Iterator[Node]:
        return (self.nodes[place - 1] for place in self.places if place)


class Full:
    """A child, or none, for each byte."""

    __slots__ = ("nodes",)

    def __init__(self, grown: Indexed):
        self.nodes = [grown.find(byte) for byte in range(256)]

    def find(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> Full:
        self.nodes[byte] = node
        return self

    def children(self) -> Iterator[Node]:
        return (node for node in self.nodes if node is not None)


class Node:
    """A path of bytes that nothing branches from, and what follows it.

    `start` and `end` are the depths in bytes where the path begins (with the byte it was found by) and ends; its bytes are
    those of any key below it, so the key of `first`, the least row below, stands for them. `last` is the greatest row below,
    `ends` are the rows whose key ends here.
    """

    __slots__ = ("start", "end", "first", "last", "ends", "layout", "sums")

    def __init__(self, start: int, end: int, row: int):
        self.start, self.end, self.first, self.last = start, end, row, row
        self.ends: list[int] = []
        self.layout: Sorted | Indexed | Full | None = None
        self.sums: tuple = ()

    def children(self) -> Iterator[Node]:
        return self.layout.children() if self.layout else iter(())


def common_length(a: bytes, b: bytes, start: int, end: int) -> int:
    """Where a and b first differ from `start` on; `end` if they don't before it."""
    if a[start:end] == b[start:end]:
        return end
    while end - start > 1:  # a and b differ somewhere in start..end
        middle = (start + end) // 2
        if a[start:middle] == b[start:middle]:
            start = middle
        else:
            end = middle
    return start


def build(keys: list[bytes]) -> Node | None:
    """The tree of the keys; None without keys. Equal keys end in one node. The keys may come in any order."""
    if not keys:
        return None
    top = Node(0, 0, 0)
    for row, key in enumerate(keys):
        above = node = top
        while True:
            at = common_length(key, keys[node.first], node.start, min(node.end, len(key)))
            if at < node.end:  # the path is left before its end: cut it in two
                upper = Node(node.start, at, node.first)
                upper.layout = Sorted().put(keys[node.first][at], node)
                above.layout = above.layout.put(key[upper.start], upper)  # the top's empty path is never cut
                node.start, node = at, upper
            node.last = row
            if len(key) == at:
                node.ends.append(row)
                break
            child = node.layout.find(key[at]) if node.layout else None
            if child is None:
                child = Node(at, len(key), row)
                child.ends.append(row)
                node.layout = (node.layout or Sorted()).put(key[at], child)
                break
            above, node = node, child
    return top


def bottom_up(top: Node) -> Iterator[Node]:
    """Every node after those below it."""
    seen, stack = [], [top]
    while stack:
        node = stack.pop()
        seen.append(node)
        stack.extend(node.children())
    return reversed(seen)
