"""Upper-tail probabilities for result rows (a handful per report, never data rows).

Spark has no error function, so these two are vectorised Python. The functions are nested on
purpose: they travel to the executors by value, and need nothing installed there but pandas.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tenurekit.functions.columns import ColumnOrName, col


def chi2_p_value(statistic: ColumnOrName, dof: ColumnOrName) -> Column:
    """P(X > statistic) for a chi-square variable; closed form by parity of the degrees of freedom."""

    def tail(x, k):
        if pd.isna(x) or pd.isna(k) or k < 1:
            return None
        if x <= 0:
            return 1.0
        half, odd = x / 2.0, int(k) % 2 == 1
        total = math.erfc(math.sqrt(half)) if odd else 0.0
        for i in range(int(k) // 2):
            power = i + 0.5 if odd else float(i)
            total += math.exp(power * math.log(half) - half - math.lgamma(power + 1.0))
        return min(total, 1.0)

    @F.pandas_udf(DoubleType())
    def p_value(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([tail(a, b) for a, b in zip(x, k)], dtype="float64")

    return p_value(col(statistic), col(dof))


def normal_two_sided_p(z: ColumnOrName) -> Column:
    @F.pandas_udf(DoubleType())
    def p_value(values: pd.Series) -> pd.Series:
        tails = [None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0)) for v in values]
        return pd.Series(tails, dtype="float64")

    return p_value(col(z))
