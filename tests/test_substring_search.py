"""Substring searches by gram index against plain comparison."""

import random

from hypothesis import given, settings, strategies as st

from deserta.operators import substring_search as SS


def _check(spark, names, asked):
    rows = spark.createDataFrame(list(enumerate(names)), "row long, name string")
    searches = spark.createDataFrame(list(enumerate(asked)), "sid long, text string")
    got = sorted((x["row"], x["sid"]) for x in SS.rows_found(rows, "name", searches, "text").collect())
    want = sorted((i, j) for i, n in enumerate(names) for j, s in enumerate(asked)
                  if n is not None and s is not None and s.strip(" ").lower() in n.lower())
    assert got == want
    return got


def test_defined_cases(spark):
    names = ["North Valley", "north valley", None, "", "a", "aaaa", "Ünited 100%_x", "x" * 5000 + "end", "valley", "it's \\d+"]
    asked = ["VALLEY", " valley ", "", "   ", "a", "aa", "aaa", None, "%_", "ünited", "end", "zzz", "valleys", "'s \\D", "north valley"]
    assert _check(spark, names, asked)
    assert _check(spark, [], asked) == [] and _check(spark, names, []) == []


def test_random_names(spark):
    r = random.Random(3)
    names = ["".join(r.choice("abC ") for _ in range(r.randrange(12))) for _ in range(300)]
    asked = ["".join(r.choice("abc") for _ in range(r.randrange(7))) for _ in range(60)]
    assert len(_check(spark, names, asked)) > 500


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("aBé ", max_size=6), min_size=1, max_size=8), st.lists(st.text("abÉ ", max_size=4), min_size=1, max_size=4))
def test_any_names(spark, names, asked):
    _check(spark, names, asked)
