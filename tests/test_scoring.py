import math

import pytest
from pyspark.sql import functions as F

from lumengrid.config import WEIGHTS
from lumengrid.functions import scoring, text


def values(spark, rows, expr, schema="i int, x double"):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [([2, 4, 6], [0, 0.5, 1]), ([1, math.nan, 3], [0, 0, 1]), ([7, 7], [0.5, 0.5]), ([math.nan, math.nan], [0, 0]), ([None, 2.0, 4.0], [0, 0, 1]), ([1, math.inf, 3, -math.inf], [0, 1, 1, 0])],
)
def test_minmax(spark, given, wanted):
    rows = [(k, None if x is None else float(x)) for k, x in enumerate(given)]
    assert values(spark, rows, scoring.minmax) == pytest.approx(wanted)


def test_cosine_and_norm(spark):
    df = spark.createDataFrame([([2.0, 0.0],), ([0.0, 5.0],), ([-3.0, 0.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    got = [r[0] for r in df.select(scoring.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.col("v"))).collect()]
    assert got == [1.0, 0.0, -1.0, 0.0, None]
    unit = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(scoring.l2_normalize(F.col("v"))).collect()
    assert unit[0][0] == pytest.approx([0.6, 0.8]) and unit[1][0] == [0.0, 0.0]


def test_blend(spark):
    df = spark.createDataFrame([(0, 0.0, 10.0), (1, 0.5, 8.0), (2, 1.0, 9.0)], "i int, a double, b double")
    got = df.select("i", scoring.blend({"semantic": F.col("a"), "behavioral": F.col("b")}, {"semantic": 0.75, "behavioral": 0.25}).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == pytest.approx([0.25, 0.375, 0.875])


def test_shares():
    assert scoring.shares(["semantic", "quality"], WEIGHTS) == pytest.approx({"semantic": 0.75, "quality": 0.25})
    for names, weights in (([], WEIGHTS), (["other"], WEIGHTS), (["a"], {"a": 0.0})):
        with pytest.raises(ValueError):
            scoring.shares(names, weights)


@pytest.mark.parametrize(("mean", "n", "wanted"), [(0.0, 0, 3.5), (5.0, 10, 3.75), (5.0, 50, 4.25), (4.3, 1_000_000, 4.3)])
def test_shrunk_mean(spark, mean, n, wanted):
    got = spark.range(1).select(scoring.shrunk_mean(F.lit(n), F.lit(mean), F.lit(3.5), 50.0)).first()[0]
    assert got == pytest.approx(wanted, abs=1e-3)


def test_text(spark):
    none = F.array().cast("array<string>")
    row = spark.range(1).select(
        text.described(F.lit("Inception"), F.lit(2010), F.lit("A thief."), F.array(F.lit("Action"), F.lit("Sci-Fi")), F.array(F.lit("dream"), F.lit("heist"))),
        text.described(F.lit("X"), F.lit(None).cast("int"), F.lit("  "), F.array(F.lit("Drama")), none), text.described(F.lit("Obscure Film"), F.lit(0), F.lit(None).cast("string"), none, none),
        text.bare_title(F.lit("Heat (1995) ")), text.title_year(F.lit("Heat (1995)")), text.title_year(F.lit("Heat")), text.genre_list(F.lit("(no genres listed)")), text.cleaned(F.array(F.lit(" a"), F.lit("A"), F.lit(""), F.lit("b"))),
    ).first()
    assert list(row) == ["Inception (2010). A thief. Genres: Action, Sci-Fi. Keywords: dream, heist.", "X. Genres: Drama.", "Obscure Film.", "Heat", 1995, None, [], ["a", "b"]]


def test_checksum(spark):
    d = "d41d8cd98f00b204e9800998ecf8427e"
    df = spark.createDataFrame([(d,), (f"{d}  x.zip",), (f"MD5 (x.zip) = {d.upper()}",), ("none",)], "line string")
    assert [r[0] for r in df.select(text.checksum(F.col("line"))).collect()] == [d, d, d, None]
