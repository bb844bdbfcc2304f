"""Least squares with several regressors in columns: centred cross moments by aggregation, a small elimination, t values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A pivot under this share of the regressor's own variation counts as none: the regressors are then dependent.
DEPENDENT = 1e-11


def least_squares(df: DataFrame, y: Column, regressors: dict[str, Column], by: list[str], constant: str = "const") -> DataFrame:
    """One row for each group and term: by, term, beta, t and the rows n.

    Sums of products about the means are merged from partial ones, so a group of any size is never in one task's memory.
    The inverse of their matrix comes from one elimination step a regressor. Rows with a null take no part. Dependent
    regressors, and groups with no more rows than terms, have null coefficients.
    """
    names = list(regressors)
    m = len(names)
    x = df.select(*by, y.cast("double").alias("_y"), *(c.cast("double").alias(f"_x{i}") for i, c in enumerate(regressors.values()))).dropna(subset=["_y", *(f"_x{i}" for i in range(m))])
    n = F.count("*")
    cross = {f"_a{i}_{j}": F.covar_pop(f"_x{i}", f"_x{j}") * n for i in range(m) for j in range(i, m)}
    cross |= {f"_c{i}": F.covar_pop(f"_x{i}", "_y") * n for i in range(m)} | {f"_m{i}": F.avg(f"_x{i}") for i in range(m)}
    g = x.groupBy(*by).agg(n.alias("n"), F.avg("_y").alias("_my"), (F.var_pop("_y") * n).alias("_yy"), *(c.alias(k) for k, c in cross.items()))
    g = g.withColumns({f"_a{i}_{j}": F.col(f"_a{j}_{i}") for i in range(m) for j in range(i)} | {f"_d{i}": F.col(f"_a{i}_{i}") for i in range(m)})
    a = lambda i, j: F.col(f"_a{i}_{j}")
    for p in range(m):  # exchange row and column p for those of the inverse
        pivot = F.when(a(p, p) > DEPENDENT * F.col(f"_d{p}"), a(p, p))
        g = g.withColumn("_p", pivot)
        step = {}
        for i in range(m):
            for j in range(m):
                own = 1 / F.col("_p") if i == j == p else a(p, j) / F.col("_p") if i == p else -a(i, p) / F.col("_p") if j == p else a(i, j) - a(i, p) * a(p, j) / F.col("_p")
                step[f"_a{i}_{j}"] = own
        g = g.withColumns(step)
    total = lambda parts: sum(parts[1:], parts[0])
    g = g.withColumns({f"_b{i}": total([a(i, j) * F.col(f"_c{j}") for j in range(m)]) for i in range(m)})
    g = g.withColumn("_s2", F.when(F.col("n") > m + 1, F.greatest(F.lit(0.0), F.col("_yy") - total([F.col(f"_b{i}") * F.col(f"_c{i}") for i in range(m)])) / (F.col("n") - m - 1)))
    mean = [F.col(f"_m{i}") for i in range(m)]
    level = F.col("_my") - total([F.col(f"_b{i}") * mean[i] for i in range(m)])
    spread = 1 / F.col("n") + total([mean[i] * a(i, j) * mean[j] for i in range(m) for j in range(m)])
    known = F.col("_s2").isNotNull()
    term = lambda name, beta, v: F.struct(F.lit(name).alias("term"), F.when(known, beta).alias("beta"), F.try_divide(beta, F.sqrt(F.col("_s2") * v)).alias("t"))
    terms = [term(constant, level, spread), *(term(names[i], F.col(f"_b{i}"), a(i, i)) for i in range(m))]
    return g.select(*by, F.explode(F.array(*terms)).alias("_term"), F.col("n").cast("long").alias("n")).select(*by, "_term.term", "_term.beta", "_term.t", "n")
