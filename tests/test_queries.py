"""Every query of the CRM model against its DuckDB SQL."""

import math
from datetime import date, datetime
from decimal import Decimal

import pytest

from murmur.plans.all import ORACLE_SQL, QUERIES


def plain(x):
    if isinstance(x, (float, Decimal)):
        return None if isinstance(x, float) and math.isnan(x) else round(float(x), 5)
    if isinstance(x, (datetime, date)):
        return str(x)[:26].replace(" 00:00:00", "")
    return x


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(name, spark, sf, duck):
    frame = QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    relation = duck.sql(ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    at = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    assert got == want and got
