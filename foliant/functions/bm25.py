"""The ranking formula."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking formula.
K1 = 1.2
B = 0.75


def idf(n_docs: Column, df: Column) -> Column:
    return F.ln(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def tf_part(tf: Column, length: Column, avg_length: Column) -> Column:
    norm = F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * length / avg_length)
    return tf * F.lit(K1 + 1.0) / (tf + norm)


def exact(score: Column) -> Column:
    """A decimal form, so that sums do not depend on the order rows arrive in."""
    return score.cast("decimal(18,8)")


#: Parts of one that ``counted`` counts in, as many as ``exact`` keeps.
PARTS = 100_000_000


def counted(score: Column) -> Column:
    """The same as ``exact`` in a whole number of parts, which is added up at the cost of a number."""
    return F.floor(score * F.lit(float(PARTS)) + F.lit(0.5))
