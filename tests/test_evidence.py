"""The queries over faulty rows find something: a check that can only say zero shows nothing."""

import pytest

from conftest import DATA
from spindlewatch.functions import rules
from spindlewatch.plans.catalog import queries


@pytest.fixture(scope="module")
def found(spark):
    return lambda name: queries()[name](spark, DATA).collect()


def test_every_check_of_faulty_rows_counts_violations(found):
    violations = {(r.dataset, r.check_name): r.violations for r in found("quality_of_dirty_rows")}
    silent = [key for key, n in violations.items() if n == 0 and not key[1].startswith("column ")]
    assert silent == []
    assert violations["raw", "column w_s"] == 1


def test_faulty_rows_show_in_the_profile(found):
    share = {r.column_name: r.null_pct for r in found("profile_nulls_dirty")}
    assert all(share[c] > 0 for c in ("device", "timestamp", "r_s", "w_s", "svctm", "source_file", "total_iops"))
    assert share["aqu_sz"] == 0


def test_missing_devices_are_counted(found):
    missing = {r.dataset: r.n_missing for r in found("profile_coverage_with_gaps")}
    assert missing == {"device_overview": 0, "anomaly_timeline": 1, "device_health": 2}


def test_every_severity_and_cause_occurs(found):
    rows = found("hints_all_metrics")
    for detector, (floors, lowest) in rules.SEVERITY_FLOORS.items():
        assert {r.severity for r in rows if r.detector_type == detector} == {lowest, *(name for _, name in floors)}
    causes = {sentence for arms, otherwise in rules.HINTS.values() for sentence in [otherwise, *(s for _, s in arms)]}
    assert causes | {rules.UNEXPLAINED} == {r.root_cause_hint for r in rows}


def test_queued_devices_are_found(found):
    assert found("q21_queue_metrics")
