"""Every training-data query runs on the smallest data; those with SQL agree with it."""

import pytest

from scriptoria.llm import queries
from tests.parity import compare, connect

COLUMNS = {
    "p1_found": {"txt_id": "bigint", "num_linea": "int", "difetto": "string"},
    "p2_found": {"riga_id": "bigint"},
    "p3_found": {"campagna_id": "bigint", "golden_label": "string"},
    "p4_found": {"riga_a": "bigint", "riga_b": "bigint"},
    "p5_found": {"coppia_id": "bigint", "difetto": "string"},
    "p6_found": {"riga_a": "bigint", "riga_b": "bigint"},
    "p8_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p9_found": {"miscela_id": "bigint", "source": "string"},
    "p10_found": {"doc_id": "bigint"},
}


@pytest.fixture(scope="session")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, sf, name):
    df = queries.QUERIES[name](spark, sf)
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
        rows = df.collect()
        assert len(rows) == len(set(rows)), "a case is reported twice"
    if name in queries.ORACLES:
        assert compare(spark, con, sf, name, queries.QUERIES[name], queries.ORACLES[name]) is None
    elif name not in COLUMNS:
        assert df.count() >= 0
