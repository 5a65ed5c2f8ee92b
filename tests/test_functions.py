import math

import pytest
from pyspark.sql import functions as F

from strataline.functions import geophysics as G
from strataline.functions.formula import MAX_LENGTH, FormulaError, compile_formula
from strataline.functions.text import line_kind, role_key, strict_double, strict_long, trailing_number


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_formula(spark):
    df = spark.createDataFrame([(95.0, 5.0), (-1.0, 0.0), (None, 1.0)], "mag double, `base x` double")
    e, channels = compile_formula("(c('mag') + c('base x')) ** 2 / c('base x') - -1")
    assert channels == ["mag", "base x"]
    assert [r[0] for r in df.select(e).collect()] == [2001.0, None, None]
    e, _ = compile_formula("sqrt(c('mag')) + log10(abs(c('mag'))) * 2e0")
    assert [r[0] for r in df.select(F.round(e, 6)).collect()] == [round(math.sqrt(95) + 2 * math.log10(95), 6), None, None]


@pytest.mark.parametrize("bad", ["__import__('os')", "c('x').sum()", "[c('x') for x in y]", "c('x')**100", "1+2", "c(x)", "c('x') +", "(c('x')", "exp(c('x'))", "c('x') c('y')", "c('x')**-1", "c('x') + " * 200 + "1", "c('" + "x" * MAX_LENGTH + "')", ""])
def test_formula_refuses(bad):
    with pytest.raises(FormulaError):
        compile_formula(bad)


def test_closed_forms(spark):
    lit = F.lit
    r = one(
        spark,
        pole=G.normal_gravity(lit(90.0)),
        equator=G.normal_gravity(lit(0.0)),
        beyond=G.normal_gravity(lit(91.0)),
        dead=G.dead_time(lit(1000.0), 1e-4),
        height=G.height_attenuation(lit(1.0), lit(100.0), 80.0, 0.01),
        east=G.azimuth(lit(1.0), lit(0.0)),
        turn=G.angle_between(lit(350.0), lit(10.0)),
        wenner=G.geometric_factor(lit(1.0), lit(2.0), lit(2.0), lit(1.0)),
        none=G.geometric_factor(lit(1.0), lit(1.0), lit(1.0), lit(1.0)),
        live=G.live_time(lit(100.0), lit(800.0)),
        dry=G.live_time(lit(100.0), lit(1001.0)),
        phase=G.mt_phase(lit(1.0), lit(1.0)),
        half=G.butterworth_low(lit(2 * math.pi / 50), 50.0, 3),
    )
    assert abs(r["equator"] - 978032.67715) < 1e-6 and abs(r["pole"] - 983218.6368) < 1e-3 and r["beyond"] is None
    assert abs(r["dead"] - 1111.111111) < 1e-6 and abs(r["height"] - math.exp(0.2)) < 1e-12
    assert r["east"] == 90 and r["turn"] == -20 and abs(r["wenner"] - 2 * math.pi) < 1e-12 and r["none"] is None
    assert r["live"] == 125 and r["dry"] is None and r["phase"] == 45 and abs(r["half"] - math.sqrt(0.5)) < 1e-12


def test_errors(spark):
    with pytest.raises(Exception, match="dead time"):
        one(spark, x=G.dead_time(F.lit(2e4), 1e-4))
    with pytest.raises(ValueError):
        G.unmix([F.lit(1.0)] * 3, [[1, 0, 0], [1, 0, 0], [0, 0, 1]])


def test_text(spark):
    r = one(spark, key=role_key(F.lit(" Línea [m] 2")), tie=line_kind(F.lit("TL12")), line=line_kind(F.lit("FL3")), other=line_kind(F.lit("x1")), n=trailing_number(F.lit("FL003")), no=trailing_number(F.lit("FL")), whole=strict_long(F.lit("-12")), big=strict_long(F.lit("9" * 30)), text=strict_long(F.lit("1.5")), number=strict_double(F.lit("-99,9"), True), bad=strict_double(F.lit("1,000")))
    assert (r["key"], r["tie"], r["line"], r["other"]) == ("lineam2", "tie", "traverse", "other")
    assert (r["n"], r["no"], r["whole"], r["big"], r["text"], r["number"], r["bad"]) == (3, None, -12, None, None, -99.9, None)
