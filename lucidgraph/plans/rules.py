"""Horn-like rules over triples: atoms, canonical form, identity, text forms. Plain values, never columns."""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from itertools import permutations

ANCHOR = "?x"


def is_var(term: str) -> bool:
    return term.startswith("?")


@dataclass(frozen=True, order=True)
class Atom:
    """A triple pattern; a term that starts with ``?`` is a variable."""

    s: str
    p: str
    o: str

    def args(self) -> tuple[str, str]:
        return self.s, self.o

    def variables(self) -> list[str]:
        return [t for t in self.args() if is_var(t)]

    def readable(self) -> str:
        return f"({local_name(self.s)} {local_name(self.p)} {local_name(self.o)})"


@dataclass(frozen=True)
class Rule:
    """``head <= body``. ``qualities`` hold the measures of the head's cluster; equality ignores them and the head."""

    head: Atom
    body: tuple[Atom, ...] = ()
    qualities: Mapping[str, float] = field(default_factory=dict, compare=False, hash=False)
    anchors: tuple[str, ...] = (ANCHOR,)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Rule) and self.key() == other.key()

    def __hash__(self) -> int:
        return hash(self.key())

    def key(self) -> tuple[Atom, ...]:
        """The body in canonical form: of all ways to number the free variables, the one with the least sorted atoms.

        Bodies are short, so all ways are tried (up to 5 variables); a longer body is numbered in the order of its
        sorted atoms, which can miss that two bodies are the same.
        """
        free = sorted({v for a in self.body for v in a.variables() if v not in self.anchors})
        ways = permutations(free) if len(free) <= 5 else [tuple(dict.fromkeys(v for a in sorted(self.body) for v in a.variables() if v in free))]
        best = None
        for way in ways:
            named = {v: f"?y{i + 1}" for i, v in enumerate(way)}
            found = tuple(sorted(Atom(named.get(a.s, a.s), a.p, named.get(a.o, a.o)) for a in self.body))
            best = found if best is None or found < best else best
        return best or ()

    def rule_id(self) -> str:
        return hashlib.sha256(json.dumps([[a.s, a.p, a.o] for a in self.key()]).encode()).hexdigest()[:16]

    def path_key(self) -> tuple[Atom, ...]:
        """Identity of path rules: the atoms as they are."""
        return self.body

    def extended(self, atom: Atom) -> Rule:
        return Rule(self.head, (*self.body, atom), {}, self.anchors)

    def variables(self) -> list[str]:
        """Anchors, then body variables in the order of their first appearance."""
        return list(dict.fromkeys([*self.anchors, *(v for a in self.body for v in a.variables())]))

    def predicates(self) -> list[str]:
        return [a.p for a in self.body]

    def directions(self) -> list[bool]:
        """For each atom, whether it leaves the node it is attached to: True for an out-edge."""
        seen, out = set(self.anchors), []
        for a in self.body:
            out.append(a.s in seen)
            seen |= {a.s, a.o}
        return out

    def open_variables(self) -> list[str]:
        """Variables that occur an odd number of times, counting the anchor's own place; a path grows at its open end."""
        count: dict[str, int] = {}
        for v in (*self.anchors, *(v for a in self.body for v in a.variables())):
            count[v] = count.get(v, 0) + 1
        return [v for v, n in count.items() if n % 2]

    def dangling(self) -> str:
        """The object of the last atom: the term that a constant is bound to."""
        return self.body[-1].o

    def bound(self, value: str) -> Rule:
        last = self.body[-1]
        return Rule(self.head, (*self.body[:-1], Atom(last.s, last.p, value)), {}, self.anchors)

    def is_categorical_unbound(self, categorical: Iterable[str]) -> bool:
        known = set(categorical)
        return any(a.p in known and is_var(a.o) for a in self.body)

    def __len__(self) -> int:
        return len(self.body)

    def text(self) -> str:
        """``head <= atoms`` and the measures, readable."""
        marks = "\t".join(f"{k}: {v:.4f}" if isinstance(v, float) else f"{k}: {v!r}" for k, v in self.qualities.items())
        return f"{self.head.readable()}\t<=\t{', '.join(a.readable() for a in self.body)}\t{marks}".rstrip("\t")

    def parsable(self) -> str:
        """One line that ``parse`` reads back."""
        return repr([[self.head.s, self.head.p, self.head.o], [[a.s, a.p, a.o] for a in self.body], dict(self.qualities)])


def parse(line: str) -> Rule:
    """Reads ``parsable`` text as literals only; nothing in it is run."""
    head, body, qualities = ast.literal_eval(line)
    return Rule(Atom(*head), tuple(Atom(*a) for a in body), qualities)


def local_name(term: str) -> str:
    """The path of a URL without its leading slash; other terms as they are."""
    if term.startswith(("http:", "https:")):
        rest = term.split("://", 1)[-1]
        return rest.partition("/")[2].split("?")[0].split("#")[0] or term
    return term


def rank(rules: Iterable[Rule], measure: str = "x_coverage") -> list[Rule]:
    """Best first; equal ones by canonical body."""
    return sorted(rules, key=lambda r: (-(r.qualities.get(measure) if r.qualities.get(measure) is not None else float("-inf")), r.rule_id()))


def top(rules: Iterable[Rule], k: int = 10, measure: str = "x_coverage") -> list[Rule]:
    return rank(rules, measure)[:k]
