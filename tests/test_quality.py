"""Places of values that can't be written."""

import math

from tripweave.operators import quality as ql


def test_places_in_nested_columns(spark):
    schema = ("trip_id long, x float, s struct<a:double,t:struct<b:array<double>>,n:int>, m map<string,struct<v:double>>, "
              "k map<double,int>, `odd.name` double, plain string")
    nan, inf = math.nan, math.inf
    rows = [(1, nan, (inf, ([1.0, nan, None],), 3), {"p": (-inf,), "q": (1.0,)}, {inf: 1}, nan, "NaN"),
            (2, None, None, None, None, None, None), (3, 1.0, (1.0, None, 1), {}, {1.0: 1}, 2.0, "x"), (4, 1.0, (nan, ([],), 1), {"p": None}, None, 0.0, "")]
    got = {tuple(r) for r in ql.non_finite_values(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, "x", "NaN"), (1, "s.a", "Infinity"), (1, "s.t.b[1]", "NaN"), (1, "m[p].v", "-Infinity"),
                   (1, "k{}", "Infinity"), (1, "odd.name", "NaN"), (4, "s.a", "NaN")}
    assert ql.non_finite_values(spark.createDataFrame([(1, "a")], "trip_id long, b string")).count() == 0
