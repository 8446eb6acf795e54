"""Plan properties: nothing funnels data rows through one task."""

import re

import pytest

import __spark_entry__ as E

# these two materialise tables while being built (checkpoints, shard files)
SIDE_EFFECTS = {"shard_roundtrip", "resume_build", "artifact_tables", "resume_source", "build_progress", "window_fetch", "published_files",
                "rank_export", "metric_rows", "summary_file", "pinned_encoder", "live_rate", "live_throttle"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in set(E.queries()) - SIDE_EFFECTS if n != "pipeline" and not n.startswith("op")))
def test_no_single_task_over_rows(spark, sf, name):
    p = plan_of(E.queries()[name](spark, sf))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    lines = p.split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1]
            # only partial aggregates (one row per partition) or per-bucket
            # tables (possibly checkpointed: a scan of (_pb, _ps) rows)
            assert re.search(r"(Hash|ObjectHash|Sort)Aggregate|Scan ExistingRDD\[_pb", child), (name, child)


def test_limit_is_applied_before_the_shuffle(spark, sf):
    p = plan_of(E.queries()["limit_per_task"](spark, sf))
    assert "WindowGroupLimit" in p


def test_top_k_is_applied_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan_of(E.queries()["candidate_topk"](spark, sf))


def test_build_encodes_once_after_the_offsets_shuffle(spark, sf):
    p = plan_of(E.queries()["pack_windows"](spark, sf))
    assert p.count("MapInArrow") == 1
    enc = p.index("MapInArrow")
    assert "Exchange hashpartitioning(_pb" in p[enc:]      # the shuffle is below (before) the encoder


def test_offsets_window_is_partitioned_by_bucket(spark, sf):
    p = plan_of(E.queries()["token_offsets"](spark, sf))
    assert re.search(r"Window \[.*\], \[_pb", p)


def test_telemetry_windows_are_partitioned_by_block(spark, sf):
    p = plan_of(E.queries()["interval_average"](spark, sf))
    for m in re.finditer(r"Window \[.*?\], \[(.*?)\]", p):
        keys = m.group(1)
        # every window over log rows is partitioned by run and a clock block
        # (the per-block tables are partitioned by run only)
        assert "run_id" in keys
