"""A suffix automaton over words that grows text by text."""

from __future__ import annotations


class SuffixAutomaton:
    """States know the longest text that reaches them; `add` reports matching statistics.

    Texts are added in order. For each position of an added text, `add` gives the
    length of the longest run of words ending there that already ended earlier, in
    a text added before or further left in this one.
    """

    def __init__(self) -> None:
        self.edges: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, items) -> list[int]:
        edges, link, length = self.edges, self.link, self.length
        last, at, found = 0, 0, []
        for item in items:
            at += 1
            known = edges[last].get(item)
            if known is not None:
                # The whole text up to here has been seen.
                if length[known] == length[last] + 1:
                    last = known
                else:
                    last = self._clone(last, item, known)
                found.append(at)
                continue
            new = len(length)
            edges.append({})
            length.append(length[last] + 1)
            link.append(0)
            state = last
            while state != -1 and item not in edges[state]:
                edges[state][item] = new
                state = link[state]
            if state != -1:
                target = edges[state][item]
                if length[target] != length[state] + 1:
                    target = self._clone(state, item, target)
                link[new] = target
            found.append(length[link[new]])
            last = new
        return found

    def _clone(self, state: int, item, target: int) -> int:
        """Split off the part of `target` that is reached from `state`."""
        edges, link, length = self.edges, self.link, self.length
        copy = len(length)
        edges.append(dict(edges[target]))
        link.append(link[target])
        length.append(length[state] + 1)
        link[target] = copy
        while state != -1 and edges[state].get(item) == target:
            edges[state][item] = copy
            state = link[state]
        return copy
