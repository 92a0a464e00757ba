"""Rule values: canonical form, identity, text forms."""

from hypothesis import given
from hypothesis import strategies as st

from lucidgraph.plans.rules import Atom, Rule, local_name, parse, rank, top

HEAD = Atom("?x", "member", "c1")


def rule(*atoms, head=HEAD, **qualities):
    return Rule(head, tuple(Atom(*a) for a in atoms), qualities)


def test_equal_under_order_names_and_head():
    a = rule(("?x", "p1", "?y"), ("?y", "p2", "class"))
    assert a == rule(("?y", "p2", "class"), ("?x", "p1", "?y"))
    assert a == rule(("?x", "p1", "?z"), ("?z", "p2", "class"))
    assert a == rule(("?x", "p1", "?y"), ("?y", "p2", "class"), head=Atom("?x", "member", "c2"))
    assert a.rule_id() == rule(("?z", "p2", "class"), ("?x", "p1", "?z")).rule_id()


def test_not_equal():
    a = rule(("?x", "p1", "?y"), ("?y", "p2", "class"))
    assert a != rule(("?x", "p1", "?y"))
    assert a != rule(("?x", "p1", "?y"), ("?y", "p2", "?z"))
    assert a != rule(("?x", "p1", "?y"), ("?y", "p2", "other"))
    assert a != rule(("?y", "p1", "?x"), ("?y", "p2", "class"))


def test_set_sizes():
    found, sizes = set(), []
    for r in (
        rule(("?x", "p1", "?y")), rule(("?x", "p2", "?y")), rule(("?x", "p1", "?z")), rule(("?x", "p1", "a")), rule(("?x", "p1", "b")), rule(("?x", "p1", "?y"), ("?y", "p2", "a")),
        rule(("?q", "p2", "a"), ("?x", "p1", "?q")),
    ):
        found.add(r)
        sizes.append(len(found))
    assert sizes == [1, 2, 2, 3, 4, 5, 5]


@given(st.permutations(range(4)), st.permutations(["?a", "?b", "?c"]))
def test_identity_ignores_order_and_names(order, names):
    atoms = [("?x", "p", names[0]), (names[0], "q", names[1]), (names[2], "p", names[0]), (names[1], "r", "k")]
    plain = rule(("?x", "p", "?1"), ("?1", "q", "?2"), ("?3", "p", "?1"), ("?2", "r", "k"))
    assert rule(*[atoms[i] for i in order]).rule_id() == plain.rule_id()


def test_parse_runs_nothing():
    r = rule(("?x", "p", "o'\"\\"), x_coverage=0.25, c_support=3)
    back = parse(r.parsable())
    assert back == r and back.qualities == {"x_coverage": 0.25, "c_support": 3} and back.head == HEAD
    try:
        parse("__import__('os').getcwd()")
    except ValueError:
        pass
    else:
        raise AssertionError("code was read as a rule")


def test_open_end_directions_and_binding():
    r = rule(("?y", "p", "?x"), ("?y", "q", "?z"))
    assert r.open_variables() == ["?z"] and r.directions() == [False, True] and r.dangling() == "?z"
    assert r.bound("k").body[-1] == Atom("?y", "q", "k") and r.bound("k").open_variables() == []
    assert r.is_categorical_unbound(["q"]) and not r.bound("k").is_categorical_unbound(["q"])
    assert rule().open_variables() == ["?x"]


def test_rank_and_text():
    a, b = rule(("?x", "p", "a"), x_coverage=0.5), rule(("?x", "p", "b"), x_coverage=0.7)
    assert rank([a, b]) == [b, a] and top([a, b], 1) == [b]
    assert b.text() == "(?x member c1)\t<=\t(?x p b)\tx_coverage: 0.7000"
    assert local_name("http://h/a/b?q") == "a/b" and local_name("k") == "k"
