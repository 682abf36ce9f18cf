"""Sequential weighted transducers over small alphabets: composition, minimisation, runs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

Arc = tuple[str, float, int]


@dataclass(frozen=True)
class Transducer:
    """From each state, an input symbol leads by one arc to an output symbol, a weight and the next state; it begins in state 0."""

    arcs: Mapping[tuple[int, str], Arc]

    @property
    def states(self) -> set[int]:
        return {0, *(s for s, _ in self.arcs), *(a[2] for a in self.arcs.values())}

    def run(self, symbols: Iterable[str]) -> Iterator[tuple[str, float]]:
        """The output of each input symbol."""
        state = 0
        for x in symbols:
            out, weight, state = self.arcs[state, x]
            yield out, weight

    def compose(self, after: Transducer) -> Transducer:
        """The transducer that reads as this one does and writes what ``after`` writes for this one's output; weights add up."""
        by_state: dict[int, list[tuple[str, Arc]]] = {}
        for (s, x), arc in self.arcs.items():
            by_state.setdefault(s, []).append((x, arc))
        number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        while todo:
            pair = todo.pop()
            for x, (middle, weight, to) in by_state.get(pair[0], []):
                arc = after.arcs.get((pair[1], middle))
                if arc is None:
                    continue
                out, more, then = arc
                if (to, then) not in number:
                    number[to, then] = len(number)
                    todo.append((to, then))
                arcs[number[pair], x] = (out, weight + more, number[to, then])
        return Transducer(arcs)

    def minimal(self) -> Transducer:
        """The same mapping with as few states as can be: states that no input tells apart become one."""
        symbols, states = sorted({x for _, x in self.arcs}), sorted(self.states)
        block = dict.fromkeys(states, 0)
        while True:
            kinds: dict[tuple, int] = {}
            new = {}
            for s in states:
                seen = tuple((a[0], a[1], block[a[2]]) if (a := self.arcs.get((s, x))) else None for x in symbols)
                new[s] = kinds.setdefault((block[s], seen), len(kinds))  # state 0 comes first and stays 0
            if len(kinds) == len(set(block.values())):
                break
            block = new
        return Transducer({(block[s], x): (out, weight, block[to]) for (s, x), (out, weight, to) in self.arcs.items()})


def rewriting(symbols: Iterable[str], states: Iterable[int], rules: Mapping[tuple[int, str], Arc], follow: Mapping[int, int] | None = None) -> Transducer:
    """A transducer that passes every symbol on, but for ``rules``; ``follow`` says where a state goes by itself (default: it stays)."""
    go = follow or {}
    return Transducer({(s, x): rules.get((s, x), (x, 0.0, go.get(s, s))) for s in states for x in symbols})
