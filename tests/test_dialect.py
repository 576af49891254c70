import pytest
from hypothesis import given
from hypothesis import strategies as st

from logspar.plans.dialect import Numeric, Search, leading_unsigned, parse_compat, parse_strict, strict_query
from logspar.plans.plan_cache import PlanCache

READINGS = [
    ("status == 500 AND latency > 100", (500, 100)),
    ("status==500&&latency>100", (500, 100)),
    ("(status == 500) AND (latency > 100)", (500, 100)),
    ("status == 500 OR latency > 100", (500, 100)),
    ("status == 500 || latency > 100", (500, 100)),
    ("latency > 100", (0, 100)),
    ("status == 500", (500, 0)),
    ("status > 400", (400, 0)),
    ("status != 500 AND latency > 1", (500, 1)),
    ("NOT status == 500", (500, 0)),
    ("latency < 100", (0, 100)),
    ("latency >= 100", (0, 100)),
    ("latency>=100", (0, 0)),
    ("status ==500 AND latency > 100", (0, 0)),
    ("status== 500 AND latency >100", (500, 0)),
    ("status == 200 AND status == 500", (500, 0)),
    ("http_status == 404", (404, 0)),
    ("status == -5", (18446744073709551611, 0)),
    ("status == 5xx", (5, 0)),
    ("latency > 18446744073709551616", (0, 0)),
    ("status=500 AND latency>100", (0, 0)),
    ("status==500,latency>100", (500, 0)),
    ("500 == status", (0, 0)),
    ("trace_id == abc", (0, 0)),
    ('contains("a>b")', (0, 0)),
]


@pytest.mark.parametrize("text, wanted", READINGS)
def test_compat_numeric(text, wanted):
    assert parse_compat(text) == Numeric(*wanted)


@pytest.mark.parametrize("text, pattern", [("status != 500", "status != 500"), ('contains("ERROR")', "ERROR"), ("contains(x y)", "x y"), ('"q"', "q"), ("  bare ", "bare"), ("", ""), ("contains()", "")])
def test_compat_search(text, pattern):
    assert parse_compat(text) == Search(pattern)


@pytest.mark.parametrize("text, pattern", [('contains( "ERROR" )', "ERROR"), ("contains( a b )", "a b"), ("'q'", "'q'"), ("contains('q')", "'q'"), ('contains(" q ")', " q ")])
def test_compat_unwrapping(text, pattern):
    assert parse_compat(text) == Search(pattern)


def test_ascii_digits_only():
    assert parse_compat("status == \u0663") == Numeric(0, 0) and parse_compat("status == 5\u0663") == Numeric(5, 0)
    assert parse_compat("status == 7\u00a0latency > 5") == Numeric(7, 0)  # only ASCII blanks part words


def test_strict_fields(spark):
    with pytest.raises(ValueError):
        parse_strict("status == \u0663")
    assert strict_query('a == 1 AND (b != "x" OR a > 2)')[1] == {"a": "number", "b": "text"}
    with pytest.raises(ValueError):
        strict_query('a == 1 AND a == "x"')


@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
def test_compat_round_trip(a, b):
    assert parse_compat(f"status == {a} AND latency > {b}") == Numeric(a, b)
    assert leading_unsigned(f"{a}x") == a


def test_strict(spark):
    rows = spark.createDataFrame([(500, 120, "a"), (200, 5, "b"), (None, 9, "c")], "status bigint, latency bigint, name string")
    names = lambda q: [r.name for r in rows.filter(parse_strict(q)).orderBy("name").collect()]
    assert names("status == 500 OR latency < 6") == ["a", "b"]
    assert names('NOT (status == 500) AND name != "z"') == ["b"]
    for bad in ("status =", "status == ", "(status == 1", "status == 1 1", "latency 5", "%"):
        with pytest.raises(ValueError):
            parse_strict(bad)


def test_plan_cache_keeps_blanks_of_patterns():
    cache = PlanCache(9)
    assert cache.get_or_make('"a  b"', parse_compat) == Search("a  b") and cache.get_or_make('"a b"', parse_compat) == Search("a b")


def test_plan_cache():
    cache = PlanCache(2)
    cache.insert(1, "a")
    cache.insert(2, "b")
    assert cache.lookup(1) == "a"
    cache.insert(3, "c")
    assert cache.lookup(2) is None and cache.lookup(1) == "a" and cache.lookup(3) == "c"
    assert cache.get_or_make("x  y", str.upper) == cache.get_or_make("x y", str.lower) == "X  Y"
    with pytest.raises(ValueError):
        PlanCache(0)
