"""A catalogue from which no table can be had without its tenant filter (S3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Catalogue:
    """Tables of a folder, each with the column that names its tenant.

    The only way to rows is ``of(tenant)``.  A table without a tenant column isn't in the catalogue, and asking for it is an
    error; shared tables are named as such.  A null or empty tenant sees no row of a tenant's table.
    """

    def __init__(self, spark: SparkSession, folder: str, tenant_columns: dict[str, str], shared: tuple[str, ...] = ()):
        self._spark, self._folder, self._columns, self._shared = spark, folder, dict(tenant_columns), tuple(shared)

    @property
    def names(self) -> list[str]:
        return sorted([*self._columns, *self._shared])

    def of(self, tenant: object) -> Scope:
        return Scope(self, tenant)


class Scope:
    """One tenant's view; the filter is part of every scan and reaches the files as a pushed filter."""

    def __init__(self, catalogue: Catalogue, tenant: object):
        self._catalogue, self._tenant = catalogue, tenant

    def table(self, name: str) -> DataFrame:
        own = self._catalogue
        if name not in own.names:
            raise KeyError(f"{name} has no tenant column")
        rows = own._spark.read.parquet(f"{own._folder}/{name}.parquet")
        if name in own._shared:
            return rows
        if self._tenant is None or self._tenant == "":
            return rows.filter(F.lit(False))
        return rows.filter(F.col(own._columns[name]) == F.lit(self._tenant))
