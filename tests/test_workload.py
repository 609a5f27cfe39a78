"""Registered queries against their SQL. A few by default; all with ALL_QUERIES=1."""

import datetime
import json
import os

import numpy as np
import pytest

import workload
from tests.compare import differences

SAMPLE = ["find_by_tags", "cooccur_bound", "tag_combinations", "value_linear", "seq_gaps", "turn_rate", "from_to", "batch_features", "wrong_labels",
          "online_state_changes"]
NAMES = sorted(workload.ORACLES) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, name):
    assert differences(workload.QUERIES[name](spark, sf_dir), workload.ORACLES[name], sf_dir) is None


def test_every_oracle_has_a_query():
    assert set(workload.ORACLES) <= set(workload.QUERIES)


def test_local_regression_uses_all_dimensions(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x, y = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows], float)
    a = np.hstack([x, np.ones((len(x), 1))])
    got = {r.query_id: r.prediction for r in workload.QUERIES["local_regression"](spark, sf_dir).collect()}
    assert set(got) == {r.vec_id for r in rows}
    for i in range(0, len(rows), 10):
        w = np.sqrt(np.exp(-((x - x[i]) ** 2).sum(axis=1) / 2))
        assert got[rows[i].vec_id] == pytest.approx(a[i] @ np.linalg.lstsq(a * w[:, None], y * w, rcond=None)[0], abs=1e-6)


@pytest.mark.parametrize("name", ["pattern_matches", "pattern_windows_stream"])
def test_patterns_see_both_dimensions(spark, tmp_path, name):
    # both users' values make the peak; only the first one's k stays level
    peak = [20.0, 0.0, 1.0, 3.0, 9.0, 3.0, 1.0, 0.0, 20.0, 5.0]
    rows = [(10 * u + i, datetime.datetime(2024, 1, 1, 0, 0, i), u, "click", v, json.dumps({"k": (0, 97 * i % 50)[u - 1]})) for u in (1, 2) for i, v in enumerate(peak)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert {r.event_id for r in workload.QUERIES[name](spark, str(tmp_path)).collect()} == {1}
