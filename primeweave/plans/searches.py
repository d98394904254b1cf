"""The divisor search over the squarefree odd keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from primeweave import shared_folder
from primeweave.operators import divisors, search
from primeweave.plans import numbers
from primeweave.plans.registry import query


@query("dstar_sweep")
def _(spark, d):
    """(n, mask, d): the divisor chosen for each key once a sweep no longer lowers the objective."""
    shared_folder(spark)  # where the search's checkpoints go
    rows, _ = search.search(numbers.squarefree(spark, d).where(F.size("ps") >= 2))
    value = F.aggregate(divisors.subset_of(F.col("ps"), F.col("mask")), F.lit(1).cast("long"), lambda a, p: a * p)
    return rows.select("n", "mask", value.alias("d"))
