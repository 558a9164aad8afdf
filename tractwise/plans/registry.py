"""Named queries and, where one exists, the SQL that must return the same rows."""

from .tables import Tables, with_sql

QUERIES = {}
ORACLES = {}


def query(name, views="", sql=None):
    """Register fn(tables) -> DataFrame under `name`; `sql` may read the named derived views."""
    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_sql(views, sql) if views else sql
        return fn
    return add
