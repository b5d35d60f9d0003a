"""All registered queries: name -> (function of session and folder, check SQL or None)."""

from __future__ import annotations

from functools import wraps

from runloom.plans import catalog_eval, catalog_match, catalog_more, catalog_sources, catalog_steps
from runloom.plans.store import joins_by_size

MODULES = (catalog_steps, catalog_match, catalog_eval, catalog_sources, catalog_more)


def _sized(fn):
    @wraps(fn)
    def query(spark, sf_dir):
        joins_by_size(spark)
        return fn(spark, sf_dir)
    return query


def all_queries() -> dict:
    out = {}
    for module in MODULES:
        for name, (fn, sql) in module.QUERIES.items():
            if name in out:
                raise ValueError(f"query registered twice: {name}")
            out[name] = (_sized(fn), sql)
    return out
