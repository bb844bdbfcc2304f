"""Pareto tails of return columns: a batch holds many replicates of one series, fitted as a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.tails import pareto_tails

#: Replicates of a batch.
BATCH = 250
THRESHOLDS = (0.85,)


def pareto(df: DataFrame, by: list[str], replicate: str | None = None, thresholds: tuple[float, ...] = THRESHOLDS, least: int = 10, batch: int = BATCH) -> DataFrame:
    """es5, es1, var5, var1, shape and exceedances n above each threshold u, for every group and replicate.

    `df` has the text columns `by`, an integer replicate if there are any, and returns r without nulls.
    """
    names = [*by, *([replicate] if replicate else [])]

    def run(rows: pa.Table) -> pa.Table:
        b, r = rows["_b"].to_numpy(), rows["r"].to_numpy()
        order = np.argsort(b, kind="stable")
        found, start, count = np.unique(b[order], return_index=True, return_counts=True)
        out: list[pa.Table] = []
        for size in np.unique(count):  # replicates of one length make a matrix
            own = count == size
            losses = -r[order][(start[own][:, None] + np.arange(size))]
            for u in thresholds:
                t = pareto_tails(losses, u, (0.05, 0.01), least)
                n = int(own.sum())
                cols = {c: pa.array([rows[c][0].as_py()] * n, pa.string()) for c in by} | ({replicate: pa.array(found[own], pa.int32())} if replicate else {})
                cols |= {"u": pa.array(np.full(n, u)), "es5": pa.array(t.es[0.05]), "es1": pa.array(t.es[0.01]), "var5": pa.array(t.var[0.05]), "var1": pa.array(t.var[0.01]), "shape": pa.array(t.shape), "n": pa.array(t.n)}
                out.append(pa.table(cols))
        return pa.concat_tables(out)

    number = F.col(replicate).cast("int") if replicate else F.lit(0)
    rows = df.select(*by, number.alias("_b"), F.col("r").cast("double").alias("r")).withColumn("_batch", F.floor(F.col("_b") / batch))
    types = ", ".join([*(f"{c} string" for c in by), *([f"{replicate} int"] if replicate else []), "u double, es5 double, es1 double, var5 double, var1 double, shape double, n long"])
    return rows.groupBy(*by, "_batch").applyInArrow(run, types).select(*names, "u", "es5", "es1", "var5", "var1", "shape", "n")
