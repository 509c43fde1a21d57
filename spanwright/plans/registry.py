"""Collects the named queries of the plan modules."""

from __future__ import annotations

from . import evaluation, retrieval

_MODULES = (retrieval, evaluation)


def queries():
    found = {}
    for module in _MODULES:
        found.update(module.QUERIES)
    return found


def oracle_sql():
    found = {}
    for module in _MODULES:
        found.update(module.ORACLES)
    return found


def flagship(spark, sf_dir):
    return queries()["bm25_topk"](spark, sf_dir)
