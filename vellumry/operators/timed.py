"""Joins by time within a key, without comparing all pairs of a key's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, at: str, value: str, into: str, tie: str, inclusive: bool = False) -> DataFrame:
    """left with `into`: the value of the last right row of the same key before left's time `at` (or at it, if inclusive), the greatest `tie` among equals; null
    if there is none. Both sides are sorted together once, and a window carries the last value on, so a key of a million rows costs a sort, not their pairs."""
    kinds = {c: right.schema[c].dataType for c in (tie, value)}
    a = left.select(F.struct(*left.columns).alias("__row"), F.col(key).alias("__k"), F.col(at).alias("__t"), F.lit(1 if inclusive else 0).alias("__o"), F.lit(None).cast(kinds[tie]).alias("__tie"), F.lit(None).cast(kinds[value]).alias("__v"), F.lit(False).alias("__is"))
    b = right.select(F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(key).alias("__k"), F.col(at).alias("__t"), F.lit(0 if inclusive else 1).alias("__o"), F.col(tie).alias("__tie"), F.col(value).alias("__v"), F.lit(True).alias("__is"))
    w = Window.partitionBy("__k").orderBy("__t", "__o", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("__last", F.last(F.when(F.col("__is"), F.struct(F.col("__v").alias("v"))), ignorenulls=True).over(w))
    return both.where(~F.col("__is")).select("__row.*", F.col("__last.v").alias(into))


def within(left: DataFrame, right: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Pairs of a left and a right row (prefixed l_ and r_) of one key whose right time follows the left one by more than 0 and at most `seconds`.

    Time is cut into bins of that length: a pair lies in one bin or in neighbours, so each left row is sent to two bins, and rows of one key are spread over its bins.
    """
    number = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns], F.explode(F.array(number(at), number(at) + 1)).alias("__lb"))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], number(at).alias("__rb"))
    later: Column = (F.col(f"r_{at}") > F.col(f"l_{at}")) & (F.col(f"r_{at}") <= F.col(f"l_{at}") + F.expr(f"INTERVAL {int(seconds)} SECONDS"))
    return a.join(b, (F.col(f"l_{key}") == F.col(f"r_{key}")) & (F.col("__lb") == F.col("__rb")) & later).drop("__lb", "__rb")
