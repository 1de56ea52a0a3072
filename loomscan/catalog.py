"""All registered queries of the library proper, gathered from the operator modules."""

from loomscan.operators import drift, entities, expressions, joins, listing, mapping, merging, names, pages, patterns, presets, ranking, reports, search, selectors, sets
from loomscan.sources import tables
from loomscan.streaming import streams

MODULES = (drift, entities, expressions, joins, listing, mapping, merging, names, pages, patterns, presets, ranking, reports, search, selectors, sets, streams, tables)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
