"""Scalar semantics, with the traps of Spark's own operators."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import arith, checks, collections, paths, regexps, strings

L = F.lit


def ints(*xs):
    return F.array(*[L(x).cast("long") for x in xs]) if xs else F.array().cast("array<bigint>")


def raises(value, column, text=""):
    with pytest.raises(Exception, match=text):
        value(column)


@pytest.mark.parametrize("a,b,q,r", [(7, 2, 3, 1), (-7, 2, -4, 1), (7, -2, -3, 1), (-7, -2, 4, 1), (6, 3, 2, 0), (-6, 3, -2, 0)])
def test_euclidean(value, a, b, q, r):
    a, b = L(a).cast("long"), L(b).cast("long")
    assert (value(arith.int_div(a, b)), value(arith.int_mod(a, b))) == (q, r)


def test_division_by_zero(value):
    raises(value, arith.int_div(L(1), L(0)), "division by zero")
    assert value(arith.float_div(L(1.0), L(0.0))) == math.inf
    assert value(arith.float_div(L(-1.0), L(0.0))) == -math.inf
    raises(value, arith.float_div(L(0.0), L(0.0)))


def test_shifts(value):
    assert value(arith.shift_left(L(3), L(2))) == 12
    assert value(arith.shift_right(L(-5), L(1))) == -3
    assert value(arith.shift_right(L(5), L(200))) == 0
    assert value(arith.shift_left(L(0), L(500))) == 0
    raises(value, arith.shift_left(L(1), L(63)), "overflow")
    raises(value, arith.shift_left(L(1), L(64)), "overflow")
    raises(value, arith.shift_left(L(1), L(-1)), "negative")


def test_overflow_raises(value):
    raises(value, L(2**63 - 1) + L(1))


def test_casts(value):
    assert [value(arith.to_int(L(x))) for x in (1.9, -1.9, 1e30, -1e30)] == [1, -1, 2**63 - 1, -(2**63)]
    assert value(arith.to_float(L(3))) == 3.0


def test_short_circuit(value):
    assert value(arith.both(L(1) > 2, arith.panic("no").cast("boolean"))) is False
    assert value(arith.either(L(2) > 1, arith.panic("no").cast("boolean"))) is True
    assert value(arith.cond(L(True), L(1), arith.panic("no").cast("int"))) == 1
    raises(value, arith.error(3, "bad"), "error 3: bad")
    assert value(arith.delay(L(4))) == 4


def test_length_is_bytes(value):
    assert value(collections.length(L("这a"), T.StringType())) == 4
    assert value(collections.length(ints(1, 2), T.ArrayType(T.LongType()))) == 2


def test_index(value):
    assert value(collections.index(ints(5, 6), L(1))) == 6
    raises(value, collections.index(ints(5, 6), L(2)), "out of bounds")
    raises(value, collections.index(ints(5, 6), L(-1)), "out of bounds")
    m = F.create_map(L("a"), L(1))
    assert value(collections.lookup(m, L("a"))) == 1
    raises(value, collections.lookup(m, L("b")), "key not found")


def test_zip(value):
    assert [tuple(p) for p in value(collections.zip_lists(ints(1, 2), ints(3, 4)))] == [(1, 3), (2, 4)]
    raises(value, collections.zip_lists(ints(1), ints(1, 2)), "length")
    u = value(collections.unzip(collections.zip_lists(ints(1, 2), ints(3, 4))))
    assert (u["_1"], u["_2"]) == ([1, 2], [3, 4])


def test_folds(value):
    assert value(collections.fold(lambda a, x: a - x, ints(3, 2, 1), L(0).cast("long"))) == -6
    assert value(collections.fold(lambda a, x: a - x, ints(), L(9).cast("long"))) == 9
    assert value(collections.reduce(lambda a, x: a - x, ints(3, 2, 1))) == 0
    assert value(collections.reduce(lambda a, x: a - x, ints(3))) == 3
    raises(value, collections.reduce(lambda a, x: a + x, ints()), "empty")


def test_range(value):
    assert value(collections.int_range(L(1), L(4))) == [1, 2, 3]
    assert value(collections.int_range(L(1), L(1))) == []
    raises(value, collections.int_range(L(2), L(1)), "reversed")


def test_maps(value):
    pairs = F.array(*[F.struct(L(k).alias("_1"), L(v).alias("_2")) for k, v in (("a", 1), ("b", 2), ("a", 3))])
    assert value(collections.map_of(pairs)) == {"a": 3, "b": 2}
    a, b = F.create_map(L("x"), L(1), L("y"), L(2)), F.create_map(L("y"), L(9), L("z"), L(3))
    assert value(collections.merge_maps(a, b)) == {"x": 1, "y": 9, "z": 3}
    assert [tuple(e) for e in value(collections.entries(F.create_map(L("b"), L(1), L("a"), L(2))))] == [("a", 2), ("b", 1)]


def test_equality(value):
    m = T.MapType(T.StringType(), T.IntegerType())
    assert value(collections.equal(F.create_map(L("a"), L(1), L("b"), L(2)), F.create_map(L("b"), L(2), L("a"), L(1)), m))
    assert not value(collections.equal(F.create_map(L("a"), L(1)), F.create_map(L("a"), L(2)), m))
    lists = T.ArrayType(m)
    assert value(collections.equal(F.array(F.create_map(L("a"), L(1))), F.array(F.create_map(L("a"), L(1))), lists))


def test_ascribe(value):
    have = T.StructType([T.StructField("b", T.IntegerType()), T.StructField("a", T.StringType())])
    want = T.StructType([T.StructField("a", T.StringType())])
    x = F.struct(L(1).alias("b"), L("s").alias("a"))
    assert value(collections.ascribe(x, have, want)).asDict() == {"a": "s"}
    with pytest.raises(TypeError):
        collections.ascribe(x, have, T.StructType([T.StructField("c", T.StringType())]))


def test_files(value):
    file = lambda id_, etag: F.struct(L(id_).cast("string").alias("id"), L(1).alias("size"), L("s3://b/k").alias("source"), L(etag).cast("string").alias("etag"), L(None).cast("timestamp").alias("last_modified"), L(None).cast("string").alias("content_hash"))
    assert value(collections.files_equal(file("x", None), file("x", "e")))
    assert value(collections.files_equal(file(None, "e"), file(None, "e")))
    assert not value(collections.files_equal(file(None, None), file(None, None)))
    raises(value, collections.files_equal(file("x", None), file(None, "e")), "intern")


@pytest.mark.parametrize("s,sep,out", [("a.b.c", ".", ["a", "b", "c"]), ("a", "|", ["a"]), ("", ",", [""]), ("abc", "", ["a", "b", "c"]), ("a\\Eb", "\\E", ["a", "b"]), ("a,,", ",", ["a", "", ""])])
def test_split(value, s, sep, out):
    assert value(strings.split(L(s), sep)) == out


def test_chunks(value):
    assert value(strings.chunk(L("hello\tworld!!"), 100)) == ["hello\tworld!!"]
    assert value(strings.chunk(L("hello\tworld!!"), 4)) == ["hell", "o\two", "rld!", "!"]
    mixed = value(strings.chunk(L("这 \t a是否适用于 \t 复杂ef的 \n 字符串"), 6))
    assert mixed == ["这 \t ", "a是", "否适", "用于", " \t 复", "杂ef", "的 \n ", "字符", "串"]
    with pytest.raises(ValueError):
        strings.chunk(L("x"), 3)


def packed(text, most):
    out = [""]
    for c in text:
        if len((out[-1] + c).encode()) > most:
            out.append("")
        out[-1] += c
    return out if text else []


@pytest.mark.parametrize("most", [4, 7, 20])
def test_chunk_bytes(spark, most):
    rng = random.Random(most)
    texts = ["", *["".join(rng.choice("ab \n\x00é€\x80日\U0001f600") for _ in range(rng.randrange(60))) for _ in range(200)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strings.chunk(F.col("t"), most).alias("c"))
    for r in df.collect():
        assert r["c"] == packed(r["t"], most)


@pytest.mark.parametrize("x,digits,out", [(0.0, 1, "0"), (1.12121212, 2, "1.1"), (3e10, 20, "30000000000"), (1e21, 3, "1e+21"), (0.00001, 3, "1e-05")])
def test_from_float(value, x, digits, out):
    assert value(strings.from_float(L(x), digits)) == out


def test_odd_floats(value):
    inf = F.lit(float("inf"))
    assert [value(strings.from_float(x, 3)) for x in (F.lit(None).cast("double"), inf, -inf, F.lit(float("nan")))] == [None, "+Inf", "-Inf", "NaN"]


def test_last_pair_of_a_key_counts(value):
    pairs = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct((i % 3).alias("_1"), F.create_map(F.lit("v"), i).alias("_2")))
    assert value(collections.map_of(pairs)) == {0: {"v": 9}, 1: {"v": 7}, 2: {"v": 8}}


def test_to_float(value):
    assert [value(strings.to_float(L(x))) for x in ("0", "3e10", ".2", "-12.2", "0.5e-8", "1.")] == [0.0, 3e10, 0.2, -12.2, 0.5e-8, 1.0]
    raises(value, strings.to_float(L("")), "no digits")
    raises(value, strings.to_float(L("x")), "no digits")
    raises(value, strings.to_float(L("1-2")), "expected end of string")


def test_prefixes(value):
    assert value(strings.has_prefix(L("hello world"), "hell")) and value(strings.has_suffix(L("hello world"), "orld"))
    assert value(strings.join(F.array(L("a"), L("b")), ",")) == "a,b"
    assert value(strings.from_int(L(1234567890))) == "1234567890"
    assert value(strings.sort(F.array(L("b"), L("é"), L("B")))) == ["B", "b", "é"]


def test_regexps(value):
    assert value(regexps.groups(L("foo bar"), "([[:alpha:]]*) ([[:alpha:]]*)")) == ["foo", "bar"]
    raises(value, regexps.groups(L("1"), "([a-z])"), "does not match")
    assert value(regexps.replace(L("foo bar"), " (.*)", " baz")) == "foo baz"
    assert value(regexps.matches(L("foo bar"), "^foo")) and not value(regexps.matches(L("blah"), "^foo"))
    assert value(regexps.replace(L("ab"), "(a)(b)", "${2}x$1$9$$")) == "bxa$"
    assert value(regexps.replace(L("ab"), "(a)", "${1}1")) == "a1b"
    assert value(regexps.matches(L("a]b"), "[]x]")) and value(regexps.matches(L("[:"), r"[[:punct:]]"))
    assert not value(regexps.matches(L("a\n"), "a$"))


@pytest.mark.parametrize("bad", [r"(a)\1", "(?=a)", "(?<!a)b", "(?>a)", "a++", "[a", "a\\"])
def test_bad_patterns(bad):
    with pytest.raises(regexps.BadPattern):
        regexps.translate(bad)


@pytest.mark.parametrize("pattern,n", [("(a)(b)", 2), (r"\(a\)", 0), ("[(]", 0), ("(?:a)(?P<x>b)", 1), ("", 0)])
def test_group_count(pattern, n):
    assert regexps.group_count(pattern) == n


@pytest.mark.parametrize("p,base,dir_,ext", [("s3://foo/bar/baz.ext", "baz.ext", "s3://foo/bar", ".ext"), ("", ".", "", ""), ("///", "/", "//", ""), ("a", "a", "", ""), ("/a", "a", "/", ""), ("a.b/c", "c", "a.b", "")])
def test_paths(value, p, base, dir_, ext):
    assert (value(paths.base(L(p))), value(paths.dirname(L(p))), value(paths.ext(L(p)))) == (base, dir_, ext)


def test_path_join(value):
    assert value(paths.join(F.array(L("s3://foo/bar"), L(""), L("baz.ext")))) == "s3://foo/bar/baz.ext"


@pytest.mark.parametrize("glob,yes,no", [("a*", ["a", "ab"], ["b", "a/b"]), ("?.txt", ["a.txt"], ["ab.txt", "/.txt"]), ("[a-c]x", ["bx"], ["dx"]), ("[^a]x", ["bx"], ["ax"]), ("a\\*", ["a*"], ["ab"])])
def test_globs(value, glob, yes, no):
    assert all(value(paths.glob_matches(L(p), glob)) for p in yes) and not any(value(paths.glob_matches(L(p), glob)) for p in no)


def test_assertions(value):
    assert value(checks.assert_list(F.array(L(True), L(True)))) is True
    raises(value, checks.assert_list(F.array(L(True), L(False), L(False))), "1, 2")
    raises(value, checks.assert_map(F.create_map(L("b"), L(False), L("a"), L(False), L("c"), L(True))), "a, b")
    raises(value, checks.all_hold(F.array(L(True), L(False))), "failed: 1")
    assert checks.GIB == 1 << 30
