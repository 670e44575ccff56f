import oracle
import pytest

import __spark_entry__ as entry
from evenkeel.plans import queries as balancing


@pytest.mark.parametrize("name", sorted(balancing.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert oracle.same(spark, balancing.queries()[name], balancing.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_projections_recall(spark):
    exact = {(r.query_id, r.neighbor_id) for r in balancing.knn_cosine(spark, oracle.DATA).collect()}
    near = {(r.query_id, r.neighbor_id) for r in balancing.knn_projections(spark, oracle.DATA).collect()}
    assert len(near & exact) >= 0.9 * len(exact)


def test_generated_prevalence(spark):
    n = {r[0]: r[1] for r in balancing.generated_table(spark, "").groupBy("TARGET_CLASS").count().collect()}
    assert abs(n["Yes"] - 100) <= 2 and n["Yes"] + n["No"] == 2000
