"""Universes: sets of codes as set algebra over frames, evaluated when the codes are asked for."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Pool(Enum):
    """Index code or code prefixes of each pool; ALL has neither."""

    SSE50 = ("000016", None)
    CSI300 = ("000300", None)
    CSI500 = ("000905", None)
    CSI1000 = ("000852", None)
    CSI2000 = ("932000", None)
    STAR = (None, ("688",))
    CHINEXT = (None, ("300", "301"))
    BSE = (None, ("43", "83", "87"))
    SH_MAIN = (None, ("600", "601", "603", "605"))
    SZ_MAIN = (None, ("000", "001", "002", "003"))
    ALL = (None, None)

    @property
    def is_index(self) -> bool:
        return self.value[0] is not None

    @property
    def is_board(self) -> bool:
        return self.value[1] is not None

    @property
    def is_all(self) -> bool:
        return self is Pool.ALL


def normalised(code: Column | str) -> Column:
    """The six digits of a code written with a market prefix or suffix."""
    text = F.col(code) if isinstance(code, str) else code
    return F.lpad(F.regexp_extract(F.lower(text.cast("string")), r"([0-9]{1,6})", 1), 6, "0")


def starts_with(code: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [code.startswith(p) for p in prefixes])


@dataclass(frozen=True)
class Universe:
    """info: code, name, industry, list_date, out_date, status (0: delisted). members: index_code, code."""

    info: DataFrame
    members: DataFrame | None = None
    inside: tuple = ()
    outside: tuple = ()
    flags: dict = field(default_factory=lambda: {"st": True, "delisted": True, "industry": True})

    def scope(self, *items: Pool | str | list) -> Universe:
        """The union of pools, codes and lists of codes."""
        return replace(self, inside=(*self.inside, *map(_checked, items)))

    def exclude(self, *items: Pool | str | list) -> Universe:
        return replace(self, outside=(*self.outside, *map(_checked, items)))

    def filter_st(self, on: bool = True) -> Universe:
        return replace(self, flags=self.flags | {"st": on})

    def filter_delisted(self, on: bool = True) -> Universe:
        return replace(self, flags=self.flags | {"delisted": on})

    def filter_empty_industry(self, on: bool = True) -> Universe:
        return replace(self, flags=self.flags | {"industry": on})

    def resolve(self, item: Pool | list) -> DataFrame:
        """The codes of one pool or list."""
        known = self.info.select("code").distinct()
        if isinstance(item, list):
            return self.info.sparkSession.createDataFrame([(c,) for c in item], "code string").select(normalised("code").alias("code")).distinct()
        if item.is_all:
            return known
        if item.is_board:
            return known.where(starts_with(F.col("code"), item.value[1]))
        if self.members is None:
            raise ValueError("pools of an index need the members")
        return self.members.where(F.col("index_code") == item.value[0]).select("code").distinct()

    def codes(self) -> DataFrame:
        """The scope without what is excluded and what the filters remove; a code unknown to info passes them."""
        out = reduce(DataFrame.union, [self.resolve(x) for x in self.inside or (Pool.ALL,)]).distinct()
        for x in self.outside:
            out = out.join(self.resolve(x), "code", "left_anti")
        gone = F.lit(False)
        if self.flags["st"]:
            gone = gone | F.coalesce(F.upper("name").contains("ST"), F.lit(False))
        if self.flags["delisted"]:
            gone = gone | F.coalesce(F.col("status") == 0, F.lit(False))
        if self.flags["industry"]:
            gone = gone | F.col("industry").isNull() | (F.col("industry") == "")
        return out.join(self.info.where(gone).select("code"), "code", "left_anti")

    def listed(self, start, end) -> DataFrame:
        """codes() that were listed by `end` and not gone before `start`; unknown dates pass, codes without info do not."""
        span = F.coalesce(F.col("list_date") <= F.lit(end), F.lit(True)) & F.coalesce(F.col("out_date") >= F.lit(start), F.lit(True))
        return self.codes().join(self.info.where(span).select("code").distinct(), "code", "left_semi")

    def load(self, bars: DataFrame, start, end) -> DataFrame:
        """The bars of the listed codes between the dates."""
        return bars.where(F.col("date").between(F.lit(start), F.lit(end))).join(self.listed(start, end), "code", "left_semi")


def _checked(item: Pool | str | list) -> Pool | list:
    if isinstance(item, Pool):
        return item
    if isinstance(item, str):
        return [item]
    if isinstance(item, (list, tuple, set)) and all(isinstance(x, str) for x in item):
        return sorted(item)
    raise TypeError(f"neither a pool nor codes: {item!r}")


def benchmark_code(benchmark: Pool | str) -> str:
    if isinstance(benchmark, Pool):
        if not benchmark.is_index:
            raise ValueError("a benchmark has to be an index")
        return benchmark.value[0]
    return benchmark[-6:].zfill(6) if benchmark.isdigit() else "".join(c for c in benchmark if c.isdigit()).zfill(6)


def load_benchmark(index_bars: DataFrame, benchmark: Pool | str, start, end) -> DataFrame:
    return index_bars.where((F.col("code") == benchmark_code(benchmark)) & F.col("date").between(F.lit(start), F.lit(end))).orderBy("date")


def summary(bars: DataFrame) -> DataFrame:
    return bars.agg(F.countDistinct("code").alias("n_codes"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("date").alias("n_dates"), F.min("date").alias("first"), F.max("date").alias("last"))
