import pytest

from granary.plans.checks import facts
from granary.queries import QUERIES

PYTHON = {"strict_anchors", "nearest_search", "ot_pairing", "nps_spectrum", "grain", "fid_labels", "kid_labels", "stream_progress", "stream_windows", "structural_similarity", "spline_map", "ode_adaptive", "entropic_coupling", "tiled_blur", "multi_scale_similarity", "radial_spectrum", "spectrum_match"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON - {"tasks_ready", "split_overlap"}))
def test_plans_stay_in_the_jvm(spark, data, name):
    found = facts(QUERIES[name](spark, data))
    assert not found["python"] and not found["cartesian"]


def test_scans_are_pruned(spark, data):
    assert facts(QUERIES["index_links"](spark, data))["columns"] == {"page_id", "html"}
    gate = facts(QUERIES["quality_gate"](spark, data))
    assert gate["columns"] == {"source", "n_chars"} and "GreaterThanOrEqual(n_chars,512)" in gate["filters"][0]
    assert facts(QUERIES["json_field_counts"](spark, data))["exchanges"] == 1
    assert facts(QUERIES["gaussian_blur"](spark, data))["exchanges"] == 1
