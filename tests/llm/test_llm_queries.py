import os

import pytest

from compare import DATA, check, tables
from fieldmill.llm import queries as Q

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return tables()


@pytest.mark.parametrize("name", Q.SQL)
def test_query_agrees_with_sql(spark, con, name):
    check(spark, con, Q.QUERIES[name], Q.SQL[name])


def test_what_the_corpus_shows_by_itself(spark):
    """Needs more documents than the smallest table has."""
    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    alone = {r.doc_id for r in Q.p8_corpus(spark, data).collect()}
    assert alone and alone <= {r.doc_id for r in Q.p8_found(spark, data).collect()}


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n not in Q.SQL and n != "p8_corpus"])
def test_query_without_sql_runs(spark, name):
    assert Q.QUERIES[name](spark, DATA).count() > 0


def test_ids_are_the_library_s(spark):
    from fieldmill.llm import tokens as T

    texts = {r.doc_id: r.text for r in Q.table(spark, DATA, "documents").select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in Q.p6_ids(spark, DATA).collect()}
    path = f"{T.TOKENIZERS}/{T.BYTE_BPE}"
    assert got == {d: list(ids) if t else [] for (d, t), ids in zip(texts.items(), T.library_ids([t or "" for t in texts.values()], path))}
