"""Sums of doubles that are exact, whatever the order and the split: integer accumulators for bins of exponents.

A finite double is a whole number of units of 2^(24 b) in each bin b, four bins at most, and their sums are longs: they
add up in any order, over any number of parts, up to 2^39 rows. Infinities and not-a-number are counted beside
them. Only the end result is rounded. One aggregate over the column finds the bins that occur, so usual columns have
four or five accumulators, and there are never more than 92.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions._cols import named

BITS = 24
LOWEST, HIGHEST = -1074, 1023
SPECIAL = ("nan", "up", "down")


def _scaled(value: Column, power: int) -> Column:
    """value * 2^power without an infinite factor."""
    half = power // 2
    return value * F.lit(2.0**half) * F.lit(2.0 ** (power - half))


@dataclass(frozen=True)
class Whole:
    """Whole numbers and decimals: Spark's own sums are exact."""

    kind: T.DataType

    def parts(self, value: Column) -> dict[str, Column]:
        return {"sum": value}

    @property
    def sum_type(self) -> T.DataType:
        # one digit less before the point than a sum may have, so that adding two keeps all digits behind it
        return T.DecimalType(min(37, self.kind.precision + 10), self.kind.scale) if isinstance(self.kind, T.DecimalType) else T.LongType()

    def total(self, sums: Mapping[str, Column]) -> Column:
        return sums["sum"].cast("double")


@dataclass(frozen=True)
class Doubles:
    """Accumulators for the bins of exponents that a column has."""

    bins: tuple[int, ...]

    def parts(self, value: Column) -> dict[str, Column]:
        """What each row adds to each accumulator; a null adds nothing."""
        size, sign = F.abs(value), F.signum(value)
        inf = F.lit(float("inf"))
        finite = value.isNotNull() & ~F.isnan(value) & (size < inf)
        out: dict[str, Column] = {}
        for b in self.bins:
            low = _floor(_scaled(size, -BITS * b))
            limb = sign * (low - _floor(low * F.lit(2.0**-BITS)) * F.lit(2.0**BITS))
            top = BITS * (b + 1) + 53  # a larger value has no bit in this bin
            fits = finite & (size < F.lit(2.0**top)) if top <= HIGHEST else finite
            out[f"bin{b}"] = F.when(fits, limb.cast("long")).otherwise(F.lit(0).cast("long"))
        out["nan"] = F.isnan(value).cast("long")
        out["up"], out["down"] = (value == inf).cast("long"), (value == -inf).cast("long")
        return out

    sum_type = T.LongType()

    def total(self, sums: Mapping[str, Column]) -> Column:
        """The sum as a double: every bin passes what is over its width to the next, then all are added from the top."""
        sums = {k: F.coalesce(v, F.lit(0).cast("long")) for k, v in sums.items()}
        held: dict[int, Column] = {}
        for b in self.bins:
            own = sums[f"bin{b}"]
            over = F.when(own < 0, -F.shiftright(-own, BITS)).otherwise(F.shiftright(own, BITS))
            for at, part in ((b, own % F.lit(2**BITS)), (b + 1, over)):
                held[at] = held[at] + part if at in held else part
        whole = F.lit(0.0)
        for b in sorted(held, reverse=True):
            whole = whole + _scaled(held[b].cast("double"), BITS * b)
        odd = (sums["nan"] > 0) | ((sums["up"] > 0) & (sums["down"] > 0))
        return F.when(odd, F.lit(float("nan"))).when(sums["up"] > 0, F.lit(float("inf"))).when(sums["down"] > 0, F.lit(-float("inf"))).otherwise(whole)


def _floor(value: Column) -> Column:
    """Whole part of a value of 0 or more and under 2^77, as a double."""
    return F.when(value >= F.lit(2.0**53), value).otherwise(F.floor(value).cast("double"))


def number(df: DataFrame, name: str) -> Column:
    """Whole numbers and decimals as they are, everything else as a double; texts that are no numbers are null."""
    kind = df.schema[name].dataType
    return named(name) if isinstance(kind, (T.IntegralType, T.DecimalType)) else named(name).try_cast("double")


def accumulators(df: DataFrame, names: Sequence[str]) -> dict[str, Whole | Doubles]:
    """How to add up each column. Columns of doubles cost one aggregate over all of them together."""
    found: dict[str, Whole | Doubles] = {}
    floats = []
    for name in names:
        kind = df.schema[name].dataType
        if isinstance(kind, (T.IntegralType, T.DecimalType)):
            found[name] = Whole(kind)
        else:
            floats.append(name)
    if floats:
        tops = []
        for i, name in enumerate(floats):
            size = F.abs(number(df, name))
            power = F.when((size > 0) & (size < F.lit(float("inf"))), F.log2(size))
            # a logarithm that is a little off may name the bin beside
            tops += [F.collect_set(F.floor((power + F.lit(shift)) / BITS).cast("int")).alias(f"t{i}_{k}") for k, shift in enumerate((-1e-6, 1e-6))]
        row = df.agg(*tops).first()
        for i, name in enumerate(floats):
            tops_of = {*row[f"t{i}_0"], *row[f"t{i}_1"]}
            lowest = LOWEST // BITS
            found[name] = Doubles(tuple(sorted({b for t in tops_of for b in range(t - 3, t + 1) if b >= lowest})))
    return {name: found[name] for name in names}


def exact_sums(df: DataFrame, group_by: Sequence[str], columns: Mapping[str, str], count_suffix: str | None = None) -> DataFrame:
    """Sum of each column per group as a double (null without a value): ``{name: column}``; optionally the number of values.

    The accumulators are combined in the map tasks, and no order or partitioning changes a result.
    """
    how = accumulators(df, list(dict.fromkeys(columns.values())))
    wanted, out = [], []
    for i, (name, column) in enumerate(columns.items()):
        value, kind = number(df, column), how[column]
        parts = {k: f"__e{i}_{k}" for k in kind.parts(value)}
        wanted += [F.sum(v).alias(parts[k]) for k, v in kind.parts(value).items()] + [F.count(value).alias(f"__e{i}")]
        out.append(F.when(F.col(f"__e{i}") > 0, kind.total({k: named(v) for k, v in parts.items()})).alias(name))
        if count_suffix:
            out.append(F.col(f"__e{i}").alias(f"{name}{count_suffix}"))
    return df.groupBy(*[named(g) for g in group_by]).agg(*wanted).select(*[named(g) for g in group_by], *out)
