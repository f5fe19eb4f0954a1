"""Array functions as Column expressions: values bound once, and running combinations in time proportional to the length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a fold goes through before what it has made is set aside.
RUN = 128


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once, however often f uses it and wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def scan(values: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """array<kind>: what step gives for each value; step(state, value) is the next state and what is given out.

    An array can only be built up by copying it, so one fold over n elements takes n * n steps; a fold over blocks, with
    one over the elements of each, copies a block at a time.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(a: Column, x: Column) -> Column:
        nxt, out = step(a["state"], x)
        return F.struct(nxt.alias("state"), F.concat(a["out"], F.array(out)).alias("out"))

    def block(a: Column, start: Column) -> Column:
        inner = F.aggregate(F.slice(values, start + 1, RUN), F.struct(a["state"].alias("state"), none.alias("out")), one)
        return let(inner, lambda i: F.struct(i["state"].alias("state"), F.concat(a["out"], F.array(i["out"])).alias("out")))

    starts = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1, F.lit(RUN))).otherwise(F.array().cast("array<int>"))
    begin = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.flatten(F.aggregate(starts, begin, block, lambda a: a["out"]))


def sums_before(values: Column) -> Column:
    """For each int of the array the sum of those before it."""
    return scan(values, F.lit(0), "int", lambda a, x: (a + x, a))
