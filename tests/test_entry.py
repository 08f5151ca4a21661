import datetime
import decimal
import math
import os
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"


def plain(v):
    """A value as both engines show it; numbers to six digits."""
    if v is None or isinstance(v, str | bool | datetime.date):
        return v
    if isinstance(v, int | float | decimal.Decimal):
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_queries_equal_sql(spark):
    import duckdb

    from tidemark.plans import catalog, region_catalog, spatial_catalog

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for module in (catalog, region_catalog, spatial_catalog):
        for name in sorted(module.ORACLES):
            got = module.QUERIES[name](spark, SF)
            cur = con.execute(module.ORACLES[name])
            columns = [d[0] for d in cur.description]
            assert sorted(got.columns) == sorted(columns), name
            want = Counter(tuple(plain(x) for x in r) for r in cur.fetchall())
            have = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
            assert have == want, (name, list((have - want).items())[:2], list((want - have).items())[:2])
