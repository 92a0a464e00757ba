"""The text of pattern queries, for stores that take SPARQL."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from lucidgraph.plans.rules import Atom, Rule, is_var


def term(t: str) -> str:
    return t if is_var(t) or (t.startswith("<") and t.endswith(">")) else f"<{t}>"


def triple(a: Atom) -> str:
    return f"{term(a.s)} {term(a.p)} {term(a.o)}."


def _from(graphs: Sequence[str]) -> str:
    return " ".join(f"FROM <{g}>" for g in graphs)


def filters(rule: Rule) -> list[str]:
    """No predicate variable is the head's; no two variables are one node; the last atom is like none before."""
    out = [f"{a.p} != {term(rule.head.p)}" for a in rule.body if is_var(a.p)]
    out += [f"{a} != {b}" for a, b in combinations(rule.variables(), 2)]
    last = rule.body[-1] if rule.body else None
    for a in rule.body[:-1]:
        differ = [f"{term(x)} != {term(y)}" for x, y in zip((a.s, a.p, a.o), (last.s, last.p, last.o)) if x != y]
        if len(differ) == 1:
            out += differ
    return list(dict.fromkeys(out))


def _where(atoms: Sequence[Atom], conditions: Sequence[str]) -> str:
    return "WHERE {" + " ".join([*map(triple, atoms), *[f"FILTER({c})" for c in conditions]]) + "}"


def bindings(rule: Rule, graphs: Sequence[str], min_support: int = 0, limit: int = -1) -> str:
    """Anchors by the value of the open predicate, or of the last object if there is none."""
    names = [a.p for a in rule.body if is_var(a.p)] or [rule.dangling()]
    count = f"(COUNT(DISTINCT {rule.anchors[0]}) AS ?c)"
    having = f" HAVING (COUNT(DISTINCT {rule.anchors[0]}) > {min_support})" if min_support > 0 else ""
    order = " ORDER BY DESC(?c) " + " ".join(names) + (f" LIMIT {limit}" if limit > 0 else "")
    return f"SELECT {' '.join(names)} {count} {_from(graphs)} {_where([rule.head, *rule.body], filters(rule))} GROUP BY {' '.join(names)}{having}{order}"


def support(rule: Rule, graphs: Sequence[str], head: Atom | None = None) -> str:
    """Distinct anchors of a rule, with its own head or another."""
    return f"SELECT (COUNT(DISTINCT {rule.anchors[0]}) AS ?c) {_from(graphs)} {_where([head or rule.head, *rule.body], filters(rule))}"


def anchors(rule: Rule, graphs: Sequence[str], restriction: Atom | None = None) -> str:
    body = [*rule.body, *([restriction] if restriction else [])]
    return f"SELECT DISTINCT {rule.anchors[0]} {_from(graphs)} {_where(body, filters(rule))}"


def statistics(graphs: Sequence[str]) -> str:
    return f"SELECT ?p (COUNT(DISTINCT ?s) AS ?subjects) (COUNT(DISTINCT ?o) AS ?objects) {_from(graphs)} WHERE {{?s ?p ?o.}} GROUP BY ?p"
