"""Work on values that repeat: done once for each, by a join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.streaming.folders import stored


def once_of(d: DataFrame, keys: list[str], made: Callable[[DataFrame], DataFrame], name: str) -> tuple[DataFrame, DataFrame]:
    """d joined to what `made` makes of its distinct keys (rows with the keys and new columns: none, one or several for
    each), and these rows alone.

    Nulls are keys too. The keys and the made rows are tables in files, so that they are computed once and Spark knows their
    size: it broadcasts a small one, and joins a large one by a shuffle. d is read twice; store it first if it is costly.
    """
    each = stored(d.select(*keys).distinct(), f"{name}-keys")  # or Spark tests `made`'s filters on every row of d
    one = stored(made(each), name)
    own = {k: f"_once_{k}" for k in keys}
    same = F.lit(True)
    for k, o in own.items():
        same = same & F.col(k).eqNullSafe(F.col(o))
    return d.join(one.withColumnsRenamed(own), same).drop(*own.values()), one


def once(d: DataFrame, keys: list[str], made: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    return once_of(d, keys, made, name)[0]
