"""Registry tables (sources, repositories, jobs, credential index) as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Declared schemas of the registry tables (credential ciphertext is never read).
REGISTRY_SCHEMAS = {
    "sources": ("id STRING, user_id STRING, type STRING, uri STRING, name STRING, metadata STRING, status STRING, "
                "created_at TIMESTAMP, updated_at TIMESTAMP"),
    "repositories": ("id STRING, user_id STRING, name STRING, provider STRING, url STRING, branch STRING, status STRING, "
                     "source_id STRING, last_sync TIMESTAMP, files_indexed INT, created_at TIMESTAMP, updated_at TIMESTAMP"),
    "jobs": ("id STRING, source_id STRING, source_type STRING, status STRING, total_files INT, processed_files INT, "
             "code_files INT, document_files INT, created_at TIMESTAMP, updated_at TIMESTAMP, completed_at TIMESTAMP"),
    "credential_index": "repo_id STRING, user_id STRING, provider STRING, expires_at TIMESTAMP",
}

# Columns selected from the database (the credential table's secret columns are excluded).
_JDBC_QUERY = {
    "credential_index": "(SELECT repo_id, user_id, provider, expires_at FROM credentials) AS credential_index",
}


def read_registry(spark: SparkSession, location: str, table: str, jdbc_options: dict | None = None,
                  partition_column: str | None = None, lower_bound=None, upper_bound=None,
                  num_partitions: int = 8) -> DataFrame:
    """Read one registry table.

    ``location`` starting with ``jdbc:`` reads from the database; with ``partition_column``
    and bounds the read is split into ``num_partitions`` parallel range queries, and
    filters / projections on the result are pushed into the SQL. Any other location is a
    folder of parquet tables (``<location>/<table>``) read with the declared schema.
    """
    if location.startswith("jdbc:"):
        r = (spark.read.format("jdbc").option("url", location)
             .option("dbtable", _JDBC_QUERY.get(table, table)))
        for k, v in (jdbc_options or {}).items():
            r = r.option(k, v)
        if partition_column:
            r = (r.option("partitionColumn", partition_column).option("lowerBound", str(lower_bound))
                 .option("upperBound", str(upper_bound)).option("numPartitions", str(num_partitions)))
        return r.load()
    return spark.read.schema(REGISTRY_SCHEMAS[table]).parquet(f"{location.rstrip('/')}/{table}")
