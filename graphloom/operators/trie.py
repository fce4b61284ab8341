"""Token trie with a moving cursor, for matching names word by word."""

from __future__ import annotations

from collections.abc import Iterable


class TokenTrie:
    """Names as paths of tokens. The first id put on a path stays, unless ``fixed`` is false."""

    _ID = 0  # key of a node's id; tokens are strings, so it can't clash

    def __init__(self, fixed: bool = True):
        self.fixed = fixed
        self.root: dict = {}
        self.cursor = self.root

    def add(self, tokens: Iterable[str], name: str) -> None:
        node = self.root
        for t in tokens:
            node = node.setdefault(t, {})
        if not self.fixed or self._ID not in node:
            node[self._ID] = name

    def find(self, tokens: Iterable[str]) -> str | None:
        """Id at the end of a whole path, or None."""
        node: dict | None = self.root
        for t in tokens:
            node = node.get(t)
            if node is None:
                return None
        return node.get(self._ID)

    def reset(self) -> None:
        self.cursor = self.root

    def step(self, token: str) -> tuple[bool, str | None]:
        """Moves the cursor on: (whether the path goes on, id reached). A miss moves it back to the root."""
        nxt = self.cursor.get(token)
        self.cursor = self.root if nxt is None else nxt
        return nxt is not None, None if nxt is None else nxt.get(self._ID)

    def longest(self, tokens: list[str], at: int) -> tuple[int, str | None]:
        """(end, id) of the longest name that begins at ``at``; (at + 1, None) if there is none."""
        hit = (at + 1, None)
        for i in range(at, len(tokens)):
            on, name = self.step(tokens[i])
            if not on:
                break
            if name is not None:
                hit = (i + 1, name)
        return hit
