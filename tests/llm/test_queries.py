"""Every query of the text problems runs on the smallest tables; those with SQL must agree with it."""

import pytest

from schemaloom.llm import queries
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, small, con, name):
    if name in queries.SQL:
        assert compare(spark, small, name, con) == ""
    else:
        df = queries.QUERIES[name](spark, small)
        assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


def test_found_have_the_columns_that_were_asked_for(spark, small):
    wanted = {
        "p2_found": ["sent_id"], "p4_found": ["src", "rec_id", "end_pos"], "p5_found": ["sent_id_a", "sent_id_b"], "p7_found": ["src", "term", "mark"],
        "p8_found": ["pack_name", "doc_id"], "p9_found": ["source"], "p10_found": ["doc_id", "lang"],
    }
    for name, columns in wanted.items():
        assert queries.QUERIES[name](spark, small).columns == columns, name
