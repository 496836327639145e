"""All packaged analyses by id, and the packs that group them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from . import device, network, stability, telephony, wifi
from .base import Job, Tracker
from .trackers import TRACKERS

JOBS: dict[str, Job | Tracker] = {j.id: j for m in (device, stability, telephony, network, wifi) for j in m.JOBS}
JOBS.update({t.id: t for t in TRACKERS})

# Members of each pack.
PACKS = {
    "device-health": ("battery-state", "battery-events", "battery-health", "thermal-state", "cpu-load", "gpu-memory",
                      "gc-pressure-monitor", "system-server-monitor", "memory-pressure"),
    "network-connectivity": ("network-connectivity", "dns-query-events", "dns-server-stats", "dns-private-probe-tracker"),
    "samsung-security": ("samsung-auto-blocker",),
    "stability-monitor": ("crash-storm-detector", "exception-stack-tracker", "exception-storm-detector", "process-kill-storm",
                          "app-lifecycle"),
    "telephony-suite": ("cellular-registration-state", "cellular-data-failure-reporter", "radio-airplane-mode-state",
                        "radio-data-call-reporter", "sim-identity-reporter", "ims-volte-reporter"),
    "wifi-diagnostics": ("wifi-state", "wlan-disconnect-events", "wlan-disconnect-tracker", "connectivity-check-probes",
                         "p2p-group-formation-tracker", "p2p-go-negotiation-events", "p2p-wps-provisioning-tracker"),
}


def _of_type(lines: DataFrame, types: tuple[str, ...]) -> DataFrame:
    wanted = set(types) | ({"dumpstate"} if "bugreport" in types else set())
    return lines.filter(F.col("source_type").isNull() | F.lower("source_type").isin(sorted(wanted)))


def run_job(job_id: str, lines: DataFrame, sections: DataFrame | None = None, by_type: bool = False):
    """One analysis. ``by_type`` leaves out sources of a kind the job is not made for (partition pruning when stored so)."""
    job = JOBS[job_id]
    if by_type:
        lines = _of_type(lines, job.source_types)
    return job.run(lines, sections)


def pack_lines(name: str, lines: DataFrame) -> DataFrame:
    """The lines any reporter of a pack can use: one OR of their rules, worth caching when every member is a reporter."""
    members = [JOBS[j] for j in PACKS[name]]
    if not all(isinstance(j, Job) for j in members):
        return lines
    return lines.filter(reduce(lambda a, b: a | b, [j.where() for j in members]))


def run_pack(name: str, lines: DataFrame, sections: DataFrame | None = None, by_type: bool = False) -> dict:
    """All analyses of a pack over the same lines; cache or store ``lines`` before calling."""
    kept = pack_lines(name, lines)
    return {j: run_job(j, kept, sections, by_type) for j in PACKS[name]}
