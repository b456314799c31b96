"""What a look-up source must offer, and the source over a cell relation."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.operators import lookup


class LookupSource(Protocol):
    """Tables that look-up programs run over. Anything that gives its cells as (tableid, colid, rowid, term) can be one."""

    def tables(self) -> DataFrame: ...

    def column_names(self, tableid: int) -> list[str]: ...

    def find_data_keys(self, inputs: list[str]) -> DataFrame: ...

    def find_candidate_keys(self) -> DataFrame: ...

    def query(self, params: dict[int, list[str]], tableid: int, dest: int) -> DataFrame: ...

    def all_data_keys(self, inputs: list[str]) -> DataFrame: ...

    def find_all(self, inputs: list[str]) -> DataFrame: ...


class CellSource:
    """LookupSource over cells; names (tableid, colid, header) are optional."""

    def __init__(self, cells: DataFrame, names: DataFrame | None = None):
        self.cells, self.names = cells, names

    def _rows(self, inputs: list[str], name: str) -> DataFrame:
        return self.cells.sparkSession.createDataFrame([(x,) for x in inputs], f"{name} string")

    def tables(self) -> DataFrame:
        return self.cells.select("tableid").distinct()

    def column_names(self, tableid: int) -> list[str]:
        """The headers of one table; <table>-<column> where there is none."""
        own = self.cells.where(F.col("tableid") == F.lit(tableid)).select("colid").distinct()
        if self.names is not None:
            own = own.join(self.names.where(F.col("tableid") == F.lit(tableid)).groupBy("colid").agg(F.min("header").alias("header")), "colid", "left")
        else:
            own = own.withColumn("header", F.lit(None).cast("string"))
        return [r["header"] or f"{tableid}-{r['colid']}" for r in own.orderBy("colid").collect()]  # the columns of one table

    def find_data_keys(self, inputs: list[str]) -> DataFrame:
        return lookup.find_data_keys(self.cells, self._rows(inputs, "term"))

    def find_candidate_keys(self) -> DataFrame:
        return lookup.catalog_keys(self.cells)

    def query(self, params: dict[int, list[str]], tableid: int, dest: int) -> DataFrame:
        return lookup.lookup(self.cells, params, tableid, dest)

    def all_data_keys(self, inputs: list[str]) -> DataFrame:
        return lookup.all_data_keys(self.cells, self._rows(inputs, "input"))

    def find_all(self, inputs: list[str]) -> DataFrame:
        return lookup.find_all(self.cells, self._rows(inputs, "input"))
