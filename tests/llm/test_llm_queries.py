import oracle
import pytest

import corpus_pipeline
from evenkeel.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert oracle.same(spark, registry.queries()[name], registry.oracle_sql()[name])


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in sorted(registry.queries(), key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]


def test_pipeline_order():
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near copies", "mixing", "encoding"]
