"""Ordered event-log analysis on Spark DataFrames.

``functions`` build Columns, ``operators`` take and give DataFrames, ``sources`` read, parse and write,
``plans`` are packaged analyses and ``streaming`` holds the Structured Streaming forms.
"""

from .functions.extract import capture, extract_fields, field
from .functions.levels import level_name, level_ord
from .operators.aggregate import (aggregate, count_by, count_by_time, count_by_time_grouped, count_lines, level_distribution,
                                  search_summary, source_metadata, stats_field, summarize, top_tags)
from .operators.charts import Chart, build_charts, histogram, lttb
from .operators.correlate import Source, correlate, correlation_matches
from .operators.insights import Signal, insights
from .operators.ordered import global_rank, halo, look_back, rank_lines, scan
from .operators.pii import assign_tokens, detect_pii, mask_lines, mask_text, unmask
from .operators.sections import build_sections, containing_sections, in_sections, with_section
from .operators.stateful import burst_detect, carry_forward, gate_between, on_change, pair_events, running_avg
from .operators.tracker import Rule, state_at, state_intervals, track_state
from .operators.traces import group_traces
from .plans.catalog import JOBS, PACKS, run_job, run_pack
from .sources.parse import parse_bugreport, parse_kernel, parse_logcat, parse_threadtime
from .sources.text import read_lines, read_zipped_lines, write_lines, write_result
