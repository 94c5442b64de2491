"""Tries searched with Levenshtein automata."""

from __future__ import annotations


class Trie:
    """Words with a payload each; ``near`` walks the trie and a query's automaton side by side."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, payload: object) -> None:
        node = self.root
        for letter in word:
            node = node.setdefault(letter, {})
        node.setdefault("", []).append(payload)

    def near(self, query: str, bound: int) -> list[tuple[int, object]]:
        """(distance, payload) of all words within ``bound`` insertions, deletions and substitutions of ``query``.

        The automaton's states are kept as bits: bit i of level d says that i letters of the query are matched with d
        errors. A branch ends where no state is left.
        """
        size = len(query)
        inside = (1 << (size + 1)) - 1
        final = 1 << size
        at: dict[str, int] = {}
        for i, letter in enumerate(query):
            at[letter] = at.get(letter, 0) | (1 << i)
        start = tuple(((1 << (d + 1)) - 1) & inside for d in range(bound + 1))
        found: list[tuple[int, object]] = []
        stack = [(self.root, start)]
        while stack:
            node, levels = stack.pop()
            for letter, child in node.items():
                if letter == "":
                    for d, state in enumerate(levels):
                        if state & final:
                            found += [(d, payload) for payload in child]
                            break
                    continue
                mask = at.get(letter, 0)
                before, last = 0, 0
                after = []
                alive = 0
                for d, state in enumerate(levels):
                    new = (state & mask) << 1
                    if d:
                        new |= before | (before << 1) | (last << 1)
                    new &= inside
                    after.append(new)
                    alive |= new
                    before, last = state, new
                if alive:
                    stack.append((child, tuple(after)))
        return found
