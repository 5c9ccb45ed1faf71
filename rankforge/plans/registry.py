"""Registry of named queries and their SQL counterparts."""

QUERIES = {}
ORACLE = {}


def query(name, sql=None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register
