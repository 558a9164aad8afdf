"""Queries of this subpackage and the SQL each is checked against."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register fn(spark, folder) -> DataFrame under `name`."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")
