from datetime import datetime

import pytest

from ledgerlake.functions.values import Call, Link, ResolvableLink, Tag, identity, infer, like_pattern, operator_of, string_form
from ledgerlake.plans.ccl import And, Leaf, Or, Page, Sort, key_class, parse, where
from ledgerlake.plans.times import to_micros

CLOCK = lambda: datetime(2024, 3, 1, 12)


def test_and_binds_tighter_than_or_and_parentheses_bind_tightest():
    a, b, c = (Leaf(k, "EQUALS", (1,)) for k in "abc")
    assert parse("a = 1 or b = 1 and c = 1").condition == Or(a, And(b, c))
    assert parse("(a = 1 or b = 1) and c = 1").condition == And(Or(a, b), c)
    assert parse("where a = 1 && b = 1 || c = 1").condition == Or(And(a, b), c)


def test_unquoted_words_are_one_value_and_spaces_may_be_missing():
    assert parse("label = old grey skua").condition == Leaf("label", "EQUALS", ("old grey skua",))
    assert parse("label=tern").condition == Leaf("label", "EQUALS", ("tern",))
    assert parse("age>=3").condition == Leaf("age", "GREATER_THAN_OR_EQUALS", (3,))


def test_time_of_a_leaf():
    leaf = parse("a = 1 at '2024-01-02' and b = 2 at yesterday", clock=CLOCK).condition
    assert leaf.left.at == to_micros("2024-01-02") and leaf.right.at == to_micros(datetime(2024, 2, 29))


def test_local_data_quoted_functions_and_calls():
    assert parse("a = $x", {"x": 7}).condition == Leaf("a", "EQUALS", (7,))
    assert parse("a = 'avg(age)'").condition == Leaf("a", "EQUALS", ("avg(age)",))
    assert parse("a > average(age, 1, 2)").condition.values == (Call("avg", "age", (1, 2)),)
    assert parse("a > avg(age, name = foo)").condition.values[0].condition == Leaf("name", "EQUALS", ("foo",))
    assert parse("age | average > 3").condition.key == "age | avg"


def test_order_and_page():
    q = parse("a = 1 order by b desc, c page 3 size 10")
    assert q.order == (Sort("b", False), Sort("c")) and q.page == Page(20, 10)
    assert Page.number(2).next() == Page(40, 20) and Page.number(2).back() == Page(0, 20) and Page(0, 5).go(3) == Page(10, 5)


def test_builder_makes_the_same_trees():
    assert (where("a").op("=", 1) & where("b").op("bw", 1, 2).at(5)).tree == And(Leaf("a", "EQUALS", (1,)), Leaf("b", "BETWEEN", (1, 2), 5))


@pytest.mark.parametrize("text", ["a =", "= 1", "a ? 1", "(a = 1", "a = 1 b = 2 )", "a b c"])
def test_what_is_not_understood_is_refused(text):
    with pytest.raises(ValueError):
        parse(text)


@pytest.mark.parametrize("text, value", [("@12", Link(12)), ("true", True), ("`t`", Tag("t")), ("3", 3), ("3.5", 3.5), ('"3"', "3"), ("@a = 1@", ResolvableLink("a = 1")), ("|2024-01-01|", datetime(2024, 1, 1)), ("x y", "x y"), ("|05.03.2023 14h|dd.MM.yyyy HH'h'|", datetime(2023, 3, 5, 14)), ("|5/3/23|%d/%m/%y|", datetime(2023, 3, 5))])
def test_inference(text, value):
    assert infer(text) == value and type(infer(text)) is type(value)


def test_identity_and_text():
    assert identity(18) == identity(18.0) != identity("18")
    assert identity(Tag("a")) == identity("a") != identity(Link(1))
    assert string_form(18.0) == "18" and string_form(True) == "true" and string_form(Link(3)) == "@3"
    assert like_pattern(r"50\%a%_") == "50%a.*_"


@pytest.mark.parametrize("key, kind", [("a_1", "writable"), ("$id$", "identifier"), ("a.b.c", "navigation"), ("a | avg", "function"), ("a-b", "invalid"), ("a | foo", "invalid")])
def test_key_classes(key, kind):
    assert key_class(key) == kind


def test_operator_spellings():
    assert operator_of("LNKS2") == "LINKS_TO" and operator_of("not_equals") == "NOT_EQUALS" and operator_of("><") == "BETWEEN"
    with pytest.raises(ValueError):
        operator_of("===")


@pytest.mark.parametrize("phrase, when", [("now", datetime(2024, 3, 1, 12)), ("3 days ago", datetime(2024, 2, 27, 12)), ("an hour ago", datetime(2024, 3, 1, 11)), ("12", None), ("2024-01-01 05:06", datetime(2024, 1, 1, 5, 6)), ("tomorrow at 6:30 pm", datetime(2024, 3, 2, 18, 30)), ("one month ago", datetime(2024, 2, 1, 12)), ("2 years ago", datetime(2022, 3, 1, 12)), ("next friday", datetime(2024, 3, 8)), ("last friday at noon", datetime(2024, 2, 23, 12)), ("march 5th, 2023", datetime(2023, 3, 5)), ("midnight", datetime(2024, 3, 1))])
def test_time_phrases(phrase, when):
    assert to_micros(phrase, CLOCK) == (12 if when is None else to_micros(when))
