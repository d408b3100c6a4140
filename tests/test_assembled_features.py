"""Features of a row are summed over the values it has, not over all columns."""

import pyspark.ml.functions
import pytest

from caseloom.plans import training
from workload import learning_queries
from workload import views as V


@pytest.mark.parametrize("names", [3, 60])
def test_features_are_summed_without_dense_rows(spark, tmp_path, monkeypatch, names):
    kinds = ("1-URGENT", "3-MEDIUM", "5-LOW")
    orders = [(n, n % names, kinds[n % 3], "OPF"[n % 3]) for n in range(120)] + [(4, 1, "1-URGENT", "O"), (None, 2, "5-LOW", "F")]
    customers = [(n, f"Customer#{n:09d} of town{n}", ("BUILDING", "MACHINERY")[n % 2]) for n in range(names)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string").write.parquet(
        str(tmp_path / "orders.parquet")
    )
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_mktsegment string").write.parquet(
        str(tmp_path / "customer.parquet")
    )
    rows = learning_queries.cleaned(spark, str(tmp_path), "stage4")
    vectors = training.fit_features(rows, training.STAGES["stage4"], V.STOP_WORDS).transform(rows).collect()
    want = sorted((r.row_id or -1, len(r.features.toArray()), round(float(sum(r.features.toArray())), 3)) for r in vectors)

    def dense(*_, **__):
        raise AssertionError("rows are made dense")

    monkeypatch.setattr(pyspark.ml.functions, "vector_to_array", dense)
    found = learning_queries.assemble_features(spark, str(tmp_path)).collect()
    got = sorted((r.row_id or -1, r.n_features, round(r.feature_sum, 3)) for r in found)
    assert len(got) > 50 and [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 2e-3 for g, w in zip(got, want))
