"""Every registered query of the engine against its SQL counterpart, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from attesta.plans import acts, answers, census, dashboard, domain, fields, html, monitoring, publishing, registry, relational, retrieval, rule_contract, rule_sets, scalars, sql_functions, state, structure, temporal, text  # noqa: F401


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    value = lambda v: "~" if v is None else f"{v:.6g}" if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, small, name):
    found = registry.QUERIES[name](spark, small)
    db = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = db.execute(registry.ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(names)
    assert plain(found.collect(), found.columns) == plain(want.fetchall(), names)
