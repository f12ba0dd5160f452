"""Tables that a catalog knows by name, as sinks: found by strings alone, written by micro-batch."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from .sinks import conformed

SESSION_CATALOG = "spark_catalog"
_CLASS = "org.apache.iceberg.spark.SparkCatalog"
#: the table property that holds the last micro-batch written.
LAST_BATCH = "tidewheel.batch"


def mapped(df: DataFrame, fields: Mapping[str, Column | str]) -> DataFrame:
    """A row's named fields, as the table calls them."""
    return df.select(*((df[c] if isinstance(c, str) else c).alias(name) for name, c in fields.items()))


@dataclass(frozen=True)
class CatalogTable:
    """A table by catalog, address and name. Only strings are held, so it goes wherever a job goes.

    ``properties`` are the catalog's own settings, such as file system and credentials. The session's own catalog
    (``spark_catalog``) takes no address. Others need the catalog's jar on the session's class path.
    """

    catalog: str
    uri: str
    table: str
    properties: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        needed = {"catalog": self.catalog, "table": self.table} | ({} if self.catalog == SESSION_CATALOG else {"uri": self.uri})
        for name, value in needed.items():
            if not value or not value.strip():
                raise ValueError(f"{name} must not be blank")
        object.__setattr__(self, "properties", dict(self.properties))

    def settings(self) -> dict[str, str]:
        """What the session must be told of the catalog."""
        if self.catalog == SESSION_CATALOG:
            return {}
        prefix = f"spark.sql.catalog.{self.catalog}"
        return {prefix: _CLASS, f"{prefix}.type": "rest", f"{prefix}.uri": self.uri} | {f"{prefix}.{k}": v for k, v in self.properties.items()}

    def load(self, spark: SparkSession) -> DataFrame:
        """The table, its catalog made known to the session first."""
        for key, value in self.settings().items():
            spark.conf.set(key, value)
        return spark.table(f"{self.catalog}.{self.table}")

    def _last(self, spark: SparkSession) -> int:
        found = spark.sql(f"SHOW TBLPROPERTIES {self.catalog}.{self.table}").where(f"key = '{LAST_BATCH}'").first()
        return int(found["value"]) if found else -1

    def append(self, df: DataFrame, batch: int, fields: Mapping[str, Column | str] | None = None) -> bool:
        """For ``foreachBatch``: one append for each micro-batch with rows. True if it was written now.

        The rows must fit the table's columns. A batch not above the last one written is skipped; if the driver is
        lost between the rows and that note, the batch is written again. ``sinks.Table`` has no such gap.
        """
        spark = df.sparkSession
        schema = self.load(spark).schema
        rows = conformed(mapped(df, fields) if fields else df, schema)
        if batch <= self._last(spark) or df.isEmpty():
            return False
        rows.writeTo(f"{self.catalog}.{self.table}").append() if self.catalog != SESSION_CATALOG else rows.write.insertInto(self.table)
        spark.sql(f"ALTER TABLE {self.catalog}.{self.table} SET TBLPROPERTIES ('{LAST_BATCH}' = '{batch}')")
        return True
