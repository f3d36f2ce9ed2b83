"""Filtered, paged listings with facets, from a plain parameter object."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.groups import facet_counts, page

#: Friendly names of age filters and the buckets that they stand for.
AGES = {"fresh": ["fresh"], "over90": ["d90", "d180", "d365"], "over180": ["d180", "d365"], "over365": ["d365"]}


@dataclass(frozen=True)
class Listing:
    """Only what is given filters; all filters hold together."""

    equals: tuple[tuple[str, object], ...] = ()
    contains: tuple[tuple[str, str], ...] = ()
    prefix: tuple[tuple[str, str], ...] = ()
    age: str | None = None
    age_column: str = "ageBucket"
    order: tuple[tuple[str, bool], ...] = ()  # column, descending
    number: int = 1
    size: int = 20

    def tests(self) -> dict[str, Column]:
        out = {c: F.col(c) == F.lit(v) for c, v in self.equals}
        out |= {c: F.contains(F.lower(F.col(c)), F.lower(F.lit(v))) for c, v in self.contains}
        out |= {c: F.col(c).startswith(v) for c, v in self.prefix}
        if self.age:
            out[self.age_column] = F.col(self.age_column).isNull() if self.age == "none" else F.col(self.age_column).isin(AGES[self.age])
        return out

    def rows(self, df: DataFrame) -> DataFrame:
        for test in self.tests().values():
            df = df.where(test)
        return df

    def page(self, df: DataFrame) -> DataFrame:
        order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in self.order]
        return page(self.rows(df), order, self.number, self.size)

    def facets(self, df: DataFrame) -> DataFrame:
        return facet_counts(df, self.age_column, self.tests())
