import pytest
from pyspark.sql import functions as F

from orebed.functions.formula import compiled
from orebed.operators.join import containment_pairs


def test_formula(spark):
    names = {"S": F.lit(4.0), "N": F.lit(3.0)}
    for text in ("S * N + 2 ** 3", "max(S, N) / -2", "round(sqrt(S) + 0.26, 1) % 2", "min(S, N, 1)"):
        want = eval(text, {"S": 4.0, "N": 3.0, "sqrt": lambda x: x**0.5})
        assert spark.range(1).select(compiled(text, names)).head()[0] == pytest.approx(want)


@pytest.mark.parametrize("bad", ["x", "__import__('os')", "S.real", "S if N else 1", "'a'", "min(S, key=1)", "S[0]"])
def test_other_code_is_refused(spark, bad):
    with pytest.raises(ValueError):
        compiled(bad, {"S": F.lit(1.0), "N": F.lit(1.0)})


def test_containment_is_that_of_all_pairs(spark):
    words = ["кабель", "кабель ввг", "бель", "лот", "лоток", "abcd", "xabcdx", "ab", "", "xabcd"]
    df = spark.createDataFrame([("u", w) for w in words] + [("v", "кабель")], "u string, n string")
    got = {(r.u, r.left, r.right) for r in containment_pairs(df, df, "u").collect()}
    want = {("u", a, b) for a in words for b in words if a == b or min(len(a), len(b)) >= 4 and (a in b or b in a)} | {("v", "кабель", "кабель")}
    assert got == want
