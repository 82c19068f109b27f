import pytest
from pyspark.sql import functions as F

from skarn.functions.numeric import f1, number_or_null, round_exact, verdict

NAN = float("nan")
CASES = [
    (1000.0, 1000.0, "exact"), (22.18, 22.2, "close"), (1000.0, 1500.0, "wrong"), (1000.0, None, "missing"), (None, 1000.0, "spurious"), (None, None, "not_scored"),
    (233593000000.0, 233593.0, "scale_error"), (233593000000.0, 233.593, "scale_error"), (-5e6, 5e3, "wrong"), (0.0, 0.0, "exact"), (0.0, 100.0, "wrong"),
    (0.0, 0.005, "close"), (10.0, NAN, "wrong"), (10.0, float("inf"), "wrong"), (-5e6, -5e3, "scale_error"), (5.0, 0.0, "wrong"),
]


def test_verdicts(values):
    got = values([verdict(F.col("g"), F.col("p"))], [(g, p) for g, p, _ in CASES], "g double, p double")
    assert [v for (v,) in got] == [v for *_, v in CASES]


@pytest.mark.parametrize("x, want", [(2.675, 2.67), (0.125, 0.12), (3.14159, 3.14), (-2.5, -2.5)])
def test_rounding_of_the_exact_value(values, x, want):
    assert values([round_exact(F.col("x"), 2)], [(x,)], "x double") == [(want,)]


def test_numbers(values):
    assert values([number_or_null(F.col("x"))], [("1.5",), ("x",), ("NaN",), (None,)], "x string") == [(1.5,), (None,), (None,), (None,)]


def test_f1_without_anything_is_zero(values):
    assert values([f1(F.col("a"), F.col("b"), F.col("c"))], [(0, 0, 5), (0, 0, 0), (1, 2, 1)], "a int, b int, c int") == [(0.0,), (0.0,), (2 * 0.5 / 1.5,)]
