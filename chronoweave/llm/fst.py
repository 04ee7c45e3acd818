"""Weighted finite-state transducers over small alphabets, and their composition.

Weights are real numbers: along a path they multiply, over the paths of one input they add up. Arcs may be
nondeterministic; there are no empty symbols, so a path reads and writes one symbol at each step.
"""

from __future__ import annotations

from collections.abc import Iterator


class Transducer:
    """``arcs[state]`` lists (read, write, weight, next state); ``final[state]`` is the weight of ending there; 0 starts."""

    def __init__(self, arcs: dict[int, list[tuple[str, str, float, int]]], final: dict[int, float]):
        self.arcs, self.final = arcs, final
        self.by: dict[tuple[int, str], list[tuple[str, float, int]]] = {}
        for state, out in arcs.items():
            for read, write, w, to in out:
                self.by.setdefault((state, read), []).append((write, w, to))

    def paths(self, symbols: list[str], state: int = 0) -> Iterator[tuple[list[str], float]]:
        """(output, weight) of every accepted path, one by one: exponential, for tests."""
        if not symbols:
            if state in self.final:
                yield [], self.final[state]
            return
        for write, w, to in self.by.get((state, symbols[0]), ()):
            for rest, v in self.paths(symbols[1:], to):
                yield [write, *rest], w * v

    def total(self, symbols: list[str], scale: list[float] | None = None, marked: frozenset = frozenset()) -> float:
        """The sum over accepted paths; an arc that writes a ``marked`` symbol takes on the ``scale`` of its place."""
        live = {0: 1.0}
        for i, x in enumerate(symbols):
            after: dict[int, float] = {}
            for state, v in live.items():
                for write, w, to in self.by.get((state, x), ()):
                    after[to] = after.get(to, 0.0) + v * w * (scale[i] if scale and write in marked else 1.0)
            live = after
        return sum(v * self.final[state] for state, v in live.items() if state in self.final)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What ``second`` makes of what ``first`` writes; only states that can be reached and can end."""
    number = {(0, 0): 0}
    todo, arcs = [(0, 0)], {}
    while todo:
        a, b = pair = todo.pop()
        out = arcs[number[pair]] = []
        for read, between, w, to_a in first.arcs.get(a, ()):
            for write, v, to_b in second.by.get((b, between), ()):
                to = (to_a, to_b)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                if w * v:
                    out.append((read, write, w * v, number[to]))
    final = {n: first.final[a] * second.final[b] for (a, b), n in number.items() if a in first.final and b in second.final}
    useful = set(final)
    while grown := {s for s, out in arcs.items() if s not in useful and any(to in useful for *_, to in out)}:
        useful |= grown
    return Transducer({s: [x for x in out if x[3] in useful] for s, out in arcs.items() if s in useful}, final)
