"""Registry of named queries: a DataFrame builder and, where SQL can say it, its SQL."""

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    """Registers a ``(spark, sf_dir) -> DataFrame`` function under a name."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
