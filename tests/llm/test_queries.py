import pytest

from lexweave.llm import queries

COLUMNS = {
    "p2_found": ["tbl", "rec_id", "pos", "ref_id"], "p3_found": ["tbl", "rec_id", "lang"], "p4_found": ["tbl", "key_a", "key_b"], "p5_found": ["tbl", "unit", "doc_id", "label"],
    "p6_found": ["tbl", "rec_id", "end_pos"], "p7_found": ["tbl", "rec_id", "para"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    rows = df.collect()
    assert df.columns == COLUMNS[name] and rows and len(rows) == len(set(rows))
