import pytest

from tests.compare import difference, duck
from tidemark.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, registry.QUERIES[name], registry.SQL[name], SF) == ""


def test_every_query_has_a_schema(spark):
    want = {"op3_language_id": ["doc_id", "held_out", "lang_pred", "score"], "op4_toxicity": ["doc_id", "held_out", "score", "predicted"], "op6_token_store": ["doc_id", "start", "n_tokens", "ids_crc32"], "op8_html_extract": ["page_id", "url", "text", "n_chars"]}
    for name, columns in want.items():
        assert registry.QUERIES[name](spark, SF).columns == columns
