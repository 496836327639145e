"""The registry, and its flagship and ordered queries against SQL (``run_checks.py`` runs all of them)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SMALL = "/root/testdata/sf0.001"
CHECKED = ["flagship", "with_section", "in_sections", "burst_detect", "track_state", "state_at", "correlate", "pair_events", "page", "insights",
           "build_sections", "detect_pii", "assign_tokens", "tracker_wifi_state", "sim_identity", "dns_servers", "group_traces",
           "group_traces_summary", "pii_offsets", "track_then_mask", "mask_and_reveal", "source_type_is", "read_zipped_lines", "read_utf16_lines",
           "stream_lines", "stream_numbered", "pack_summary", "mask_transitions", "correlate_several_causes", "source_key", "read_annotations",
           "write_result", "stream_restart", "stream_track_late", "lttb"]


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SMALL), con, entry.oracle_sql()[name]) is None
