import os

import duckdb
import pytest

from warraq.llm import catalog

COLUMNS = {
    "p1_found": "eval_key train_key", "p2_found": "rec_key group_key", "p3_found": "field_name key_a key_b", "p4_found": "category", "p5_found": "tool item_key", "p6_found": "doc_id item_id", "p7_found": "source", "p8_found": "doc_id lang",
}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert df.columns == COLUMNS[name].split() and len(rows) == len(set(rows))
    if name in catalog.oracle_sql():
        con = duckdb.connect()
        for t in os.listdir(sf):
            con.execute(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
        con.execute(catalog.oracle_sql()[name])
        order = [[c[0] for c in con.description].index(c) for c in df.columns]
        assert sorted(rows, key=repr) == sorted((tuple(r[i] for i in order) for r in con.fetchall()), key=repr)
