"""Frames dealt by key before they fan out: the same predictions, and nothing larger than frames is shuffled."""

import re

import pytest

import __spark_entry__ as entry
from wayfield.sources import views as V

SF = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("by", [["row_key"], ["row_key", "offset_no", "fold"]])
def test_dealt_predictions_are_the_same_rows(spark, by):
    plain, dealt = V.pred_long(spark, SF), V.pred_long(spark, SF, by=by)
    assert plain.columns == dealt.columns
    assert plain.exceptAll(dealt).isEmpty() and dealt.exceptAll(plain).isEmpty()


@pytest.mark.parametrize("name", ["ensemble_rows", "pivot_predictions", "time_group_stats", "target_pred_join"])
def test_grouping_by_row_shuffles_frames_only(spark, name):
    moved = re.findall(r"Exchange hashpartitioning\(.*", plan(spark, name))
    assert moved and all("REPARTITION_BY_NUM" in line for line in moved)


@pytest.mark.parametrize("name", ["mapping_stats", "homogenise_physical", "merge_latent", "decoder_ensemble_metrics"])
def test_frames_are_dealt_before_they_fan_out(spark, name):
    text = plan(spark, name)
    assert "REPARTITION_BY_NUM" in text
    for line in re.findall(r"Exchange hashpartitioning\(.*ENSURE_REQUIREMENTS", text):
        assert "row_" not in line


@pytest.mark.parametrize("name", ["apply_affine", "apply_affine_inverse"])
def test_few_maps_are_sent_to_the_points(spark, name):
    text = plan(spark, name)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


@pytest.mark.parametrize("name", ["fold_decoder", "mapping_stats_table", "affine_fit_quality"])
def test_small_tables_are_sent_to_the_rows(spark, name):
    text = plan(spark, name)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "CoGroups" not in text


def test_numbered_rows_are_read_from_a_table(spark):
    assert "Window" not in plan(spark, "assign_fold_multi_offset")
