"""Every query against its SQL, as the driver compares them."""

from collections import Counter

import pytest

from tabulon.plans.queries import ORACLES, QUERIES


def _plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    got = Counter(tuple(_plain(r[c]) for c in columns) for r in frame.collect())
    assert got == Counter(tuple(map(_plain, r)) for r in result.fetchall())


def test_every_query_has_sql(spark, sf_dir):
    assert set(QUERIES) == set(ORACLES)
    rows = QUERIES["pages_text_extract"](spark, sf_dir).collect()
    assert rows and not any("<p>" in r.text or "<script" in r.text for r in rows)
