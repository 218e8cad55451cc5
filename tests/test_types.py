"""Unification, subtyping, digests and the checks of cases."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.operators import patterns as P
from quillon.plans import digests
from quillon.plans import types as K
from quillon.plans.types import Record, Variant


@pytest.mark.parametrize(
    "value,text",
    [
        (Record.of(f1=123, f2="okay", f3=[1, 2, 3]), "{f1 int, f2 string, f3 [int]}"),
        ([Record.of(f1=123, f2="blah"), Record.of(f2="ok", f3=321)], "[{f2 string}]"),
        ([Record.of(a=1, b=2), Record.of(a=1)], "[{a int}]"),
        ([], "[bottom]"),
        ({}, "[top:bottom]"),
        ((1, "a", 2.5), "(int, string, float)"),
        ([Variant("A", 1), Variant("B")], "[#A(int) | #B]"),
    ],
)
def test_of_python(value, text):
    assert str(K.of_python(value)) == text


def test_empty_literals_fit():
    assert K.subtype(K.of_python({}), K.Map(K.STRING, K.INT)) and K.subtype(K.of_python([]), K.List(K.INT))
    assert str(K.unify(K.of_python([]), K.List(K.INT))) == "[int]"
    assert str(K.unify(K.of_python({}), K.Map(K.INT, K.INT))) == "[int:int]"


@pytest.mark.parametrize("a,b", [(K.INT, K.STRING), (K.Tuple((K.INT,)), K.Tuple((K.INT, K.INT))), (K.Struct.of(a=K.INT), K.Struct.of(b=K.INT)), (K.Sum.of(A=None), K.Sum.of(A=K.INT)), (K.Func((K.INT,), K.INT), K.Func((K.STRING,), K.INT))])
def test_mismatches(a, b):
    with pytest.raises(K.TypeMismatch):
        K.unify(a, b)


def test_sums_unify_to_the_union():
    u = K.unify(K.Sum.of(A=None), K.Sum.of(B=K.INT))
    assert u == K.Sum.of(A=None, B=K.INT) and K.subtype(K.Sum.of(A=None), u) and not K.subtype(u, K.Sum.of(A=None))


def test_map_keys_are_contravariant():
    wide, narrow = K.Struct.of(a=K.INT), K.Struct.of(a=K.INT, b=K.INT)
    assert K.subtype(K.Map(wide, K.INT), K.Map(narrow, K.INT)) and not K.subtype(K.Map(narrow, K.INT), K.Map(wide, K.INT))


scalar = st.sampled_from([K.INT, K.FLOAT, K.STRING, K.BOOL, K.BOTTOM])
any_type = st.recursive(scalar, lambda t: st.one_of(t.map(K.List), st.tuples(t, t).map(K.Tuple), st.dictionaries(st.sampled_from("abc"), t, min_size=1).map(lambda d: K.Struct.of(**d))), max_leaves=6)


@given(any_type, any_type)
def test_unify_is_above_both(a, b):
    try:
        u = K.unify(a, b)
    except K.TypeMismatch:
        return
    assert K.subtype(a, u) and K.subtype(b, u) and K.unify(b, a) == u


def test_comparable_and_ordered():
    assert not K.comparable(K.List(K.FILESET)) and not K.comparable(K.UNIT) and K.comparable(K.Map(K.STRING, K.DIR))
    assert K.ordered(K.INT) and not K.ordered(K.BOOL)


def test_aliases():
    names = K.Aliases()
    names.define("t", K.INT)
    assert names["t"] == K.INT
    with pytest.raises(K.TypeMismatch):
        names["u"]


def test_spark_types():
    assert K.to_spark(K.Sum.of(A=None, B=K.INT)).simpleString() == "struct<tag:string,B:bigint>"
    assert K.to_spark(K.Struct.of(b=K.INT, a=K.List(K.FLOAT))).simpleString() == "struct<a:array<double>,b:bigint>"
    assert K.to_spark(K.INT, exact=0).simpleString() == "decimal(38,0)"


def test_digests():
    d = digests.value_digest
    assert d({"a": 1, "b": 2}) == d({"b": 2, "a": 1}) and d([1, 2]) != d([2, 1]) and d(1) != d("1") and d(True) != d(1)
    assert d(0.1 + 0.2) == d(0.3) and d(Record.of(a=1, b=2)) == d(Record.of(b=2, a=1))
    assert d(digests.FileRef((("id", "x"), ("source", "p")))) == d(digests.FileRef((("id", "x"), ("source", "q"))))
    assert d([[1], 2]) != d([1, [2]]) and d(["ab", "c"]) != d(["a", "bc"])


def test_column_digests(spark):
    rows = spark.createDataFrame([([1, 2], {"a": 1.0, "b": 2.0}), ([2, 1], {"b": 2.0, "a": 1.0})], "l array<int>, m map<string,double>")
    a, b = rows.select(digests.column_digest(F.col("l"), rows.schema["l"].dataType), digests.column_digest(F.col("m"), rows.schema["m"].dataType)).collect()
    assert a[0] != b[0] and a[1] == b[1]
    x, y = [[tuple(e) for e in r[0]] for r in rows.select(digests.list_in_digest_order(F.col("m"), rows.schema["m"].dataType)).collect()]
    assert x == y


V, I, W, L = P.VariantPat, P.Ident, P.Ignore(), P.ListPat
YES = K.Sum.of(Yes=None, No=None, Reason=K.STRING)


@pytest.mark.parametrize(
    "cases,t",
    [
        ([V("Yes"), V("No"), V("Reason", I("r"))], YES),
        ([V("Yes"), W], YES),
        ([L(()), L((I("h"),), I("t"))], K.List(K.INT)),
        ([L((W, W)), L((W,)), W], K.List(K.STRING)),
        ([P.TuplePat((V("Yes"), W)), P.TuplePat((W, V("No"))), W], K.Tuple((YES, YES))),
        ([P.StructPat((("a", V("Yes")),)), W], K.Struct.of(a=YES, b=K.INT)),
        ([L((L((W,)), W), I("t")), W], K.List(K.List(K.INT))),
    ],
)
def test_good_cases(cases, t):
    P.check_cases(cases, t)


@pytest.mark.parametrize(
    "cases,t,text",
    [
        ([V("Yes"), V("No")], YES, "exhaustive"),
        ([L((W,))], K.List(K.INT), "exhaustive"),
        ([L((), I("t")), L((W,))], K.List(K.INT), "case 2 is unreachable"),
        ([W, V("Yes")], YES, "case 2 is unreachable"),
        ([V("Yes"), V("No"), V("Reason", W), W], YES, "case 4 is unreachable"),
        ([P.TuplePat((V("Yes"), V("No"))), P.TuplePat((V("No"), W)), P.TuplePat((V("Reason", W), W))], K.Tuple((YES, YES)), "exhaustive"),
        ([V("Maybe"), W], YES, "does not match"),
        ([V("Yes", W), W], YES, "does not match"),
    ],
)
def test_bad_cases(cases, t, text):
    with pytest.raises(P.PatternError, match=text):
        P.check_cases(cases, t)


def test_switch(spark):
    rows = spark.createDataFrame([(["a"],), (["a", "b"],), ([],), (["x", "y", "z"],)], "l array<string>")
    t = rows.schema["l"].dataType
    cases = [(L((I("a"), I("b"))), lambda e: F.concat(e["a"], e["b"])), (L((I("a"),)), lambda e: e["a"]), (L((), I("t")), lambda e: F.size(e["t"]).cast("string"))]
    assert [r[0] for r in rows.select(P.switch(F.col("l"), t, cases, K.List(K.STRING))).collect()] == ["a", "ab", "0", "3"]


def test_nested_bind(spark):
    rows = spark.createDataFrame([([("a", "b"), ("c", "d"), ("e", "f")],)], "l array<struct<_1:string,_2:string>>")
    t = rows.schema["l"].dataType
    T2 = lambda a, b: P.TuplePat((a, b))
    p = L((T2(I("a"), W), T2(W, I("d")), T2(I("e"), I("f"))))
    got = p.bind(F.col("l"), t)
    assert rows.select(F.concat(got["a"], got["d"], got["e"], got["f"])).first()[0] == "adef"
    with pytest.raises(Exception, match="does not match"):
        rows.select(L((I("x"),)).bind(F.col("l"), t)["x"]).collect()
