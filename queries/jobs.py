"""Packaged analyses on events told in the words of the logs they read.

A text template with ``{k} {u} {c} {n}`` (props number, user, cents, line number) is written once and turned into a
Spark column and into SQL, so both sides see the same lines; the SQL then states the expected result from the numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from linespark.operators.tracker import flat_changes
from linespark.plans.catalog import JOBS, run_pack
from linespark.plans.stability import fd_exhaustion

from .adapters import LINES, event_lines, with_lines
from .registry import query

SLOTS = {"k": ("tid", "k"), "u": ("pid", "pid"), "c": ("_cents", "cents"), "n": ("line_num", "line_num")}


def _pieces(template: str) -> list[str]:
    return [p for p in re.split(r"(\{[kucn]\})", template) if p]


def told(template: str) -> Column:
    return F.concat(*[F.col(SLOTS[p[1]][0]).cast("string") if re.fullmatch(r"\{[kucn]\}", p) else F.lit(p) for p in _pieces(template)])


def told_sql(template: str) -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    return "(" + " || ".join([f"CAST({SLOTS[p[1]][1]} AS VARCHAR)" if re.fullmatch(r"\{[kucn]\}", p) else quote(p) for p in _pieces(template)] or ["''"]) + ")"


def tell(spark, sf, texts: list[tuple], level: str | None = None) -> DataFrame:
    """Lines whose tag and message (and section) come from the template number ``k % len(texts)``."""
    x = event_lines(spark, sf).withColumn("_cents", F.regexp_extract("message", r"cents=(\d+)", 1))
    i = F.col("tid") % len(texts)
    pick = lambda j: F.element_at(F.array(*[told(t[j]) if t[j] is not None else F.lit(None).cast("string") for t in texts]), i + 1)
    row = F.struct(pick(0).alias("tag"), pick(1).alias("message"), *([pick(2).alias("section")] if len(texts[0]) > 2 else []))
    x = x.drop("tag", "message", "raw").select("*", F.inline(F.array(row))).withColumn("raw", F.col("message"))
    if level is not None:
        x = x.withColumns({"level": F.lit(level), "level_ord": F.lit(4).cast("tinyint")})
    return x


def job(name, texts, part="emissions", level=None):
    return lambda spark, sf: JOBS[name].run(tell(spark, sf, texts, level))[part]


def register(name: str, job_id: str, texts: list[tuple], columns: list[str], sql: str, part: str = "emissions", level: str | None = None):
    query(name, with_lines(sql))(lambda spark, sf: JOBS[job_id].run(tell(spark, sf, texts, level))[part].select(*columns))


# -- device ---------------------------------------------------------------------------------------

BATTERY = [("BatteryService", "Sending ACTION_BATTERY_CHANGED: level:{k}, status:3, voltage:{c}, temperature:{u}, current_avg:-{k}, cycle_count:{n}"),
           ("BatteryService", "Sending ACTION_BATTERY_CHANGED: level:{k}, status:2, voltage:{c}"),
           ("BatteryService", "Sending ACTION_BATTERY_CHANGED: no numbers"), ("Other", "Sending ACTION_BATTERY_CHANGED: level:1")]
register("battery_events", "battery-events", BATTERY,
         ["source_id", "line_num", "ts_ns", "level", "status", "voltage", "temperature", "current_avg", "cycle_count"], """
SELECT source_id, line_num, ts_ns, k AS level, 'discharging' AS status, cents AS voltage, pid AS temperature, -k AS current_avg, line_num AS cycle_count
FROM lines WHERE k % 4 = 0 UNION ALL SELECT source_id, line_num, ts_ns, k, 'charging', cents, 0, 0, 0 FROM lines WHERE k % 4 = 1""")
register("battery_summary", "battery-events", BATTERY,
         ["source_id", "event_count", "min_voltage", "max_voltage", "min_temp", "max_temp", "peak_drain_current"], """
SELECT source_id, count(*) AS event_count, min(cents) AS min_voltage, max(cents) AS max_voltage, coalesce(min(pid) FILTER (k % 4 = 0 AND pid > 0), 999999) AS min_temp,
  coalesce(max(pid) FILTER (k % 4 = 0), 0) AS max_temp, coalesce(max(k) FILTER (k % 4 = 0), 0) AS peak_drain_current FROM lines WHERE k % 4 < 2 GROUP BY 1""", "summary")

CPU = [("", "Load: 1.{k} / 2.{u} / 3.5"), ("", "800%cpu {k}%user 3%nice {u}%sys 20%idle 7%iow"), ("", "  {k}.5% {u}/proc{k}: 1.{k}% user + 2.0% kernel"), ("", "quiet")]
register("cpu_load", "cpu-load", CPU, ["source_id", "line_num", "type", "load_1m", "load_5m", "cpu_user", "cpu_sys", "cpu_iow", "process", "pid", "cpu_pct", "user_pct"], """
SELECT source_id, line_num, 'load_avg' AS type, '1.' || k AS load_1m, '2.' || pid AS load_5m, NULL AS cpu_user, NULL AS cpu_sys, NULL AS cpu_iow, NULL AS process,
  NULL AS pid, NULL AS cpu_pct, NULL AS user_pct FROM lines WHERE k % 4 = 0
UNION ALL SELECT source_id, line_num, 'cpu_summary', NULL, NULL, k, pid, 7, NULL, NULL, NULL, NULL FROM lines WHERE k % 4 = 1
UNION ALL SELECT source_id, line_num, 'process', NULL, NULL, NULL, NULL, NULL, 'proc' || k, pid, k || '.5', '1.' || k FROM lines WHERE k % 4 = 2""")
register("cpu_summary", "cpu-load", CPU, ["source_id", "load_1m", "cpu_user_pct", "process_count"], """
SELECT source_id, '1.' || arg_max(k, line_num) FILTER (k % 4 = 0) AS load_1m, arg_max(k, line_num) FILTER (k % 4 = 1) AS cpu_user_pct,
  count(*) FILTER (k % 4 = 2) AS process_count FROM lines WHERE k % 4 < 3 GROUP BY 1""", "summary")

GPU = [("", "Global total: {c}000"), ("", "Proc {u} total: {n}00000"), ("", "driverPackageName = drv{u}"), ("", "vulkanVersion = {k}"), ("", "glesVersion = {u}"), ("", "Proc x")]
register("gpu_memory", "gpu-memory", GPU, ["source_id", "line_num", "type", "pid", "gpu_memory_mb", "gpu_memory_bytes"], """
SELECT source_id, line_num, 'global' AS type, NULL AS pid, cents * 1000 // 1048576 AS gpu_memory_mb, cents * 1000 AS gpu_memory_bytes FROM lines WHERE k % 6 = 0
UNION ALL SELECT source_id, line_num, 'process', pid, line_num * 100000 // 1048576, line_num * 100000 FROM lines WHERE k % 6 = 1""")
register("gpu_summary", "gpu-memory", GPU, ["source_id", "global_total_mb", "process_count", "driver_package", "gles_version", "vulkan_version"], """
SELECT source_id, arg_max(cents, line_num) FILTER (k % 6 = 0) * 1000 // 1048576 AS global_total_mb, count(*) FILTER (k % 6 = 1) AS process_count,
  'drv' || arg_max(pid, line_num) FILTER (k % 6 = 2) AS driver_package, arg_max(pid, line_num) FILTER (k % 6 = 4) AS gles_version,
  arg_max(k, line_num) FILTER (k % 6 = 3) AS vulkan_version FROM lines WHERE k % 6 < 5 GROUP BY 1""", "summary")

GC = [("art", "Background concurrent copying GC freed 1MB, 5% free, {k}MB/99MB, paused 1.2ms"), ("art", "Explicit concurrent copying {k}MB/110MB"), ("art", "Background concurrent none")]
PCT = "CASE WHEN k % 3 = 0 THEN k * 100 // 99 ELSE k * 100 // 110 END"
register("gc_pressure", "gc-pressure-monitor", GC, ["source_id", "line_num", "heap_used", "heap_pct", "pressure_state", "is_explicit"], f"""
SELECT source_id, line_num, k AS heap_used, {PCT} AS heap_pct, CASE WHEN k % 3 = 1 THEN 'explicit_gc' WHEN {PCT} > 85 THEN 'critical' WHEN {PCT} >= 70 THEN 'stressed'
  ELSE 'normal' END AS pressure_state, k % 3 = 1 AS is_explicit FROM lines WHERE k % 3 < 2""")
register("gc_summary", "gc-pressure-monitor", GC, ["source_id", "gc_count", "explicit_gc_count", "critical_count", "peak_heap_pct"], f"""
SELECT source_id, count(*) AS gc_count, count(*) FILTER (k % 3 = 1) AS explicit_gc_count, count(*) FILTER (k % 3 = 0 AND {PCT} > 85) AS critical_count,
  max({PCT}) AS peak_heap_pct FROM lines WHERE k % 3 < 2 GROUP BY 1""", "summary")

DOG = [("Watchdog", "!@Sync: {k} heap(MB): {u} / 160 FD: {n}"), ("Watchdog", "heap(MB): {k} / 100"), ("Watchdog", "FD: {n}")]
HEAP = "CASE WHEN k % 3 = 0 THEN pid * 100 // 160 ELSE k END"
FD = "CASE WHEN k % 3 = 0 THEN line_num ELSE 0 END"
register("system_server", "system-server-monitor", DOG, ["source_id", "line_num", "heap_pct", "pressure_level", "fd_count", "fd_state", "sync_num"], f"""
SELECT source_id, line_num, {HEAP} AS heap_pct, CASE WHEN {HEAP} >= 95 THEN 'critical_95+' WHEN {HEAP} >= 90 THEN 'high_90-95' WHEN {HEAP} >= 80 THEN 'elevated_80-90'
  WHEN {HEAP} >= 60 THEN 'moderate_60-80' ELSE 'normal_<60' END AS pressure_level, {FD} AS fd_count, CASE WHEN {FD} > 1000 THEN 'critical' WHEN {FD} >= 500 THEN 'elevated'
  ELSE 'normal' END AS fd_state, CASE WHEN k % 3 = 0 THEN k ELSE 0 END AS sync_num FROM lines WHERE k % 3 < 2""")
SYNC = [("Watchdog", "!@Sync: 1 heap(MB): {u} / 160 FD: {c}"), ("Watchdog", "!@Sync: 2 heap(MB): {u} / 160 FD: {c}")]
register("system_server_summary", "system-server-monitor", SYNC, ["source_id", "sample_count", "peak_fd_count", "fd_critical_count", "baseline_fd_count", "boot_fd_spike"], """
, b AS (SELECT source_id, arg_min(cents, line_num) AS base, min(line_num) AS at FROM lines WHERE k % 2 = 0 AND cents > 0 GROUP BY 1),
s AS (SELECT l.source_id, arg_min(l.cents - b.base, l.line_num) AS spike FROM lines l JOIN b ON l.source_id = b.source_id AND l.k % 2 = 1 AND l.line_num > b.at AND l.cents > b.base GROUP BY 1)
SELECT l.source_id, count(*) AS sample_count, max(cents) AS peak_fd_count, count(*) FILTER (cents > 1000) AS fd_critical_count, any_value(base) AS baseline_fd_count,
  any_value(spike) AS boot_fd_spike FROM lines l LEFT JOIN b ON l.source_id = b.source_id LEFT JOIN s ON l.source_id = s.source_id GROUP BY 1""", "summary")

# -- stability ------------------------------------------------------------------------------------

KILL = [("ActivityManager", "Killing {u}:com.app{k}/u0a1 (adj 900): #{k} cached idle adj=900 rss={c}kb"), ("ActivityManager", "Killing something"),
        ("ActivityManager", "Starting {u}:com.app"), ("Other", "Killing {u}:com.x")]
register("process_kills", "process-kill-storm", KILL, ["source_id", "line_num", "process_name", "pid", "rss_kb", "reason"], """
SELECT source_id, line_num, 'com.app' || k AS process_name, pid, cents AS rss_kb, 'cached idle' AS reason FROM lines WHERE k % 4 = 0
UNION ALL SELECT source_id, line_num, 'unknown', 0, 0, 'unknown' FROM lines WHERE k % 4 = 1""")
register("process_kill_summary", "process-kill-storm", KILL, ["source_id", "total_kills", "total_rss_freed_kb", "largest_killed_rss_kb", "largest_killed_process"], """
SELECT source_id, count(*) AS total_kills, (sum(cents) FILTER (k % 4 = 0))::BIGINT AS total_rss_freed_kb, max(cents) FILTER (k % 4 = 0) AS largest_killed_rss_kb,
  'com.app' || arg_min(k, {'x': -cents, 'l': line_num}) FILTER (k % 4 = 0) AS largest_killed_process FROM lines WHERE k % 4 < 2 GROUP BY 1""", "summary")

CRASH = [("AndroidRuntime", "Process: com.app{u}, PID: {k}"), ("AndroidRuntime", "Process: unreadable"), ("AndroidRuntime", "at com.x")]
register("crash_storm", "crash-storm-detector", CRASH, ["source_id", "line_num", "process_name", "pid"], """
SELECT source_id, line_num, 'com.app' || pid AS process_name, k AS pid FROM lines WHERE k % 3 = 0""", level="Error")


CRASH_BURSTS = """
, x AS (SELECT source_id, line_num, line_num // 2 * 1000000000 AS t, CASE WHEN k % 3 = 0 THEN 'com.app' || pid % 4 ELSE '_default' END AS key FROM lines WHERE k % 3 < 2),
y AS (SELECT *, row_number() OVER (PARTITION BY source_id, key ORDER BY line_num) AS rn, lag(line_num) OVER (PARTITION BY source_id ORDER BY line_num) AS prev FROM x),
z AS (SELECT *, rn - min(rn) OVER (PARTITION BY source_id, key ORDER BY t RANGE BETWEEN 10000000000 PRECEDING AND CURRENT ROW) + 1 >= 3 AS hot FROM y),
w AS (SELECT *, coalesce(lag(hot) OVER (PARTITION BY source_id, key ORDER BY rn), false) AS was FROM z)
SELECT source_id, key AS burst_key, coalesce(prev, 0) AS line_num, t AS ts_ns FROM w WHERE hot AND NOT was"""


def crash_lines(spark, sf):
    x = tell(spark, sf, CRASH, "Error").withColumn("ts_ns", F.expr("line_num div 2") * 10**9)
    x = x.withColumn("message", F.when(F.col("message").startswith("Process: com"), F.concat(F.lit("Process: com.app"), F.col("pid") % 4, F.lit(", PID: 1")))
                     .otherwise(F.col("message")))
    return x


@query("crash_storm_bursts", with_lines(CRASH_BURSTS))
def crash_storm_bursts(spark, sf):
    return JOBS["crash-storm-detector"].run(crash_lines(spark, sf))["bursts"].select("source_id", "burst_key", "line_num", "ts_ns")


@query("crash_storm_signals", with_lines(CRASH_BURSTS.replace("SELECT source_id, key AS burst_key", ", b AS (SELECT source_id, key AS burst_key") + """),
r AS (SELECT *, 'burst_key=' || burst_key || ', count_in_window=3, window_ms=10000' AS told, count(*) OVER (PARTITION BY source_id) AS total,
  row_number() OVER (PARTITION BY source_id ORDER BY line_num, burst_key) AS place FROM b)
SELECT source_id, 'crash_storm' AS name, 'critical' AS severity, line_num AS line, 'crash_storm: ' || told AS message, total AS signal_count, total > 20 AS truncated FROM r WHERE place <= 20"""))
def crash_storm_signals(spark, sf):
    j = JOBS["crash-storm-detector"]
    return j.insights(j.run(crash_lines(spark, sf))).select("source_id", "name", "severity", "line", "message", "signal_count", "truncated")


EXCEPTION_BURSTS = """
, x AS (SELECT source_id, line_num, line_num // 50 * 1000000000 AS t, CASE k % 3 WHEN 0 THEN 'ServiceNotFound:svc' WHEN 1 THEN 'BadStateException' ELSE 'Tag' END AS key FROM lines),
y AS (SELECT *, row_number() OVER (PARTITION BY source_id, key ORDER BY line_num) AS rn, lag(line_num) OVER (PARTITION BY source_id ORDER BY line_num) AS prev FROM x),
z AS (SELECT *, t - lag(t, 19) OVER (PARTITION BY source_id, key ORDER BY rn) <= 2000000000 AS hot FROM y),
w AS (SELECT *, coalesce(lag(hot) OVER (PARTITION BY source_id, key ORDER BY rn), false) AS was FROM z)
SELECT source_id, key AS burst_key, coalesce(prev, 0) AS line_num, t AS ts_ns FROM w WHERE hot AND NOT was"""


def exception_lines(spark, sf):
    texts = [("A", "No service published for: svc"), ("B", "java.lang.BadStateException: {k}"), ("Tag", "failed {k}")]
    x = tell(spark, sf, texts, "Error").withColumn("ts_ns", F.expr("line_num div 50") * 10**9)
    return x


@query("exception_storm_bursts", with_lines(EXCEPTION_BURSTS))
def exception_storm_bursts(spark, sf):
    return JOBS["exception-storm-detector"].run(exception_lines(spark, sf))["bursts"].select("source_id", "burst_key", "line_num", "ts_ns")


@query("exception_storm_signals", with_lines(EXCEPTION_BURSTS.replace("SELECT source_id, key AS burst_key", ", b AS (SELECT source_id, key AS burst_key") + """),
r AS (SELECT *, 'burst_key=' || burst_key || ', count_in_window=20, window_ms=2000' AS told, count(*) OVER (PARTITION BY source_id) AS total,
  row_number() OVER (PARTITION BY source_id ORDER BY line_num, burst_key) AS place FROM b)
SELECT source_id, 'exception_storm' AS name, 'critical' AS severity, line_num AS line, 'exception_storm: ' || told AS message, total AS signal_count, total > 20 AS truncated FROM r WHERE place <= 20"""))
def exception_storm_signals(spark, sf):
    j = JOBS["exception-storm-detector"]
    return j.insights(j.run(exception_lines(spark, sf))).select("source_id", "name", "severity", "line", "message", "signal_count", "truncated")


@query("exception_traces", with_lines("""
SELECT source_id, line_num, 'Comp' AS source, 'java.lang.Kind' || k || 'Exception' AS exception, false AS fatal FROM lines WHERE k % 2 = 0"""))
def exception_traces(spark, sf):
    texts = [("Comp", "java.lang.Kind{k}Exception: gone"), ("Comp", "Caused by: java.io.Deep{k}Error")]
    return JOBS["exception-stack-tracker"].run(tell(spark, sf, texts))["emissions"].select("source_id", "line_num", "source", "exception", "fatal")


@query("fd_exhaustion", with_lines("""
, g AS (SELECT *, coalesce(sum(CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp
  FROM lines WHERE k % 3 = 1 OR (k % 3 = 0 AND cents > 900))
SELECT t.source_id, t.line_num AS trigger_line, count(*) AS matches, 'FD exhaustion (' || arg_max(c.cents, c.line_num) || ' FDs in PID ' || arg_max(c.pid, c.line_num)
  || ') preceded EBADF write in PID ' || any_value(t.pid) AS message FROM g t JOIN g c ON t.k % 3 = 1 AND c.k % 3 = 0 AND t.source_id = c.source_id AND t.grp = c.grp GROUP BY 1, 2"""))
def fd_exhaustion_q(spark, sf):
    texts = [("Watchdog", "PID: {u} FD: {c}"), ("app", "E {u} write failed: EBADF"), ("app", "fine")]
    return fd_exhaustion(tell(spark, sf, texts, "Error")).select("source_id", "trigger_line", "matches", "message")


# -- telephony ------------------------------------------------------------------------------------

DATA = [("DCT-C-0", "trySetupData failed type=default, isDataEnabled() = true isUserDataEnabled=false mInternalDataEnabled=true"),
        ("DCT-C-0", "trySetupData failed type=mms] isDataEnabled() = true isUserDataEnabled=true mPolicyDataEnabled=false"),
        ("DCT-C-0", "isDataAllowedExtra: roaming {k}"), ("DCT-C-0", "There in no available apn"), ("DataEnabledSettings", "setupDataOnAllConnectableApns: r{u} now")]
register("data_failures", "cellular-data-failure-reporter", DATA, ["source_id", "line_num", "event_type", "apn_type", "reason", "user_data_enabled", "policy_data_enabled"], """
SELECT source_id, line_num, ['data_setup_failed', 'data_setup_failed', 'data_disallowed', 'no_apn_available', 'setup_all_apns'][k % 5 + 1] AS event_type,
  ['default', 'mms', 'n/a', 'n/a', 'n/a'][k % 5 + 1] AS apn_type,
  CASE k % 5 WHEN 0 THEN 'mobile data toggle OFF' WHEN 1 THEN 'policy data disabled' WHEN 2 THEN 'roaming ' || k WHEN 3 THEN 'no APN configured' ELSE 'r' || pid END AS reason,
  ['false', 'true', 'n/a', 'n/a', 'n/a'][k % 5 + 1] AS user_data_enabled, ['unknown', 'false', NULL, NULL, NULL][k % 5 + 1] AS policy_data_enabled FROM lines""")
register("data_failure_summary", "cellular-data-failure-reporter", DATA, ["source_id", "failure_count", "last_failure_reason", "no_apn_count"], """
SELECT source_id, count(*) FILTER (k % 5 < 2) AS failure_count, arg_max(CASE WHEN k % 5 = 0 THEN 'mobile data toggle OFF' ELSE 'policy data disabled' END, line_num) FILTER (k % 5 < 2)
  AS last_failure_reason, count(*) FILTER (k % 5 = 3) AS no_apn_count FROM lines GROUP BY 1""", "summary")

CALLS = [("RILJ", "> SETUP_DATA_CALL {k}"), ("RILJ", "< DATA_REGISTRATION_STATE regState: HOME rat: LTE_{k}"), ("DSM-C-0", "deactivateDataCall"),
         ("SST", "pollStateDone hasRegistered = true hasDeregistered = false"), ("RILJ", "< DATA_REGISTRATION_STATE error")]
register("data_calls", "radio-data-call-reporter", CALLS, ["source_id", "line_num", "event_type", "reg_state", "rat", "tag"], """
, x AS (SELECT *, last_value(CASE WHEN k % 5 = 1 THEN 'LTE_' || k END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM lines)
SELECT source_id, line_num, ['setup_data_call', 'data_reg_state', 'deactivate_data_call', 'poll_state_done'][k % 5 + 1] AS event_type,
  CASE WHEN k % 5 = 3 THEN 'true' WHEN r IS NULL THEN '' ELSE 'HOME' END AS reg_state, CASE WHEN k % 5 = 3 THEN 'false' ELSE coalesce(r, '') END AS rat,
  ['RILJ', 'RILJ', 'DSM-C-0', 'SST'][k % 5 + 1] AS tag FROM x WHERE k % 5 < 4""")

IMS = [("a", "onPreciseDataConnectionStateChanged state: CONNECTED transport: WWAN network type: LTE InterfaceName: if{k}"), ("a", "onDataConnectionStateChanged state: DISCONNECTED"),
       ("a", "notifyDataConnectionState: needNotify=true networkType={k} dataRegState={u}"), ("a", "notifyDataConnectionState: needNotify=false networkType=1")]
register("ims_bearers", "ims-volte-reporter", IMS, ["source_id", "line_num", "event_type", "state", "transport", "network_type", "iface"], """
SELECT source_id, line_num, 'ims_state_change' AS event_type, 'CONNECTED' AS state, 'WWAN' AS transport, 'LTE' AS network_type, 'if' || k AS iface FROM lines WHERE k % 4 = 0
UNION ALL SELECT source_id, line_num, 'ims_state_change', 'DISCONNECTED', 'unknown', 'unknown', '' FROM lines WHERE k % 4 = 1
UNION ALL SELECT source_id, line_num, 'data_connection_notify', '', '', CAST(k AS VARCHAR), CAST(pid AS VARCHAR) FROM lines WHERE k % 4 = 2""")

SIM = [("x", "getActiveSubscriptionInfoForSimSlotIndex subId={id={k} displayName=Net{k} carrierName carrierId={u} mcc=310 mnc=41 ehplmns=null countryIso=us"),
       ("x", "OperatorNumeric(31041)"), ("x", "onAllRecordsLoaded gsm.sim.operator.numeric set to '31042'"), ("x", "DNS resolution failed for epdg server: resolve host \"h{k}\"")]
register("sim_identity", "sim-identity-reporter", SIM, ["source_id", "line_num", "event_type", "sim_plmn", "network_plmn", "display_name", "carrier_id"], """
, w AS (SELECT *, k % 4 AS kind, min(CASE WHEN k % 4 = 2 THEN line_num END) OVER p AS first_op, min(CASE WHEN k % 4 = 0 THEN line_num END) OVER p AS first_sub,
    bool_or(k % 4 = 1) OVER r AS net, last_value(CASE WHEN k % 4 = 0 THEN 'Net' || k END IGNORE NULLS) OVER r AS name FROM lines
  WINDOW p AS (PARTITION BY source_id), r AS (PARTITION BY source_id ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT source_id, line_num, ['subscription_info', '', 'sim_records_loaded', 'epdg_dns_failure'][kind + 1] AS event_type,
  CASE WHEN line_num >= first_sub THEN '31041' WHEN line_num >= first_op THEN '31042' ELSE '' END AS sim_plmn, CASE WHEN net THEN '31041' ELSE '' END AS network_plmn,
  CASE WHEN kind = 3 THEN 'h' || k ELSE coalesce(name, '') END AS display_name, CASE WHEN kind = 0 THEN CAST(pid AS VARCHAR) ELSE '' END AS carrier_id FROM w WHERE kind != 1""")

# -- network --------------------------------------------------------------------------------------

PROBE = [("NetworkMonitor/{u}", "PROBE_DNS host{k} {c}ms OK 1.2.3.4"), ("NetworkMonitor/{u}", "PROBE_DNS host{k} {c}ms FAIL in type ADDRCONFIG java.net.UnknownHostException"),
         ("NetworkMonitor", "PROBE_HTTPS https://h{k}/gen time={c}ms ret=204"), ("NetworkMonitor", "PROBE_HTTP http://h{k}/gen Probe failed with exception java.net.SocketTimeoutException: slow"),
         ("NetworkMonitor", "isCaptivePortal: isSuccessful()=false isPortal()=true isPartialConnectivity()=false RedirectUrl=http://p{k} Time={u}ms"), ("Other", "PROBE_DNS x 1ms OK y")]
register("connectivity_probes", "connectivity-check-probes", PROBE, ["source_id", "line_num", "probe_type", "host", "url", "duration_ms", "result", "failure_reason", "net_id", "validation_time_ms"], """
SELECT source_id, line_num, ['DNS', 'DNS', 'HTTPS', 'HTTP', 'VERDICT'][k % 6 + 1] AS probe_type, CASE WHEN k % 6 < 2 THEN 'host' || k END AS host,
  CASE k % 6 WHEN 2 THEN 'https://h' || k || '/gen' WHEN 3 THEN 'http://h' || k || '/gen' END AS url, CASE WHEN k % 6 < 3 THEN cents END AS duration_ms,
  ['OK', 'FAIL', 'OK', 'FAIL', 'portal'][k % 6 + 1] AS result, [NULL, 'DNS NXDOMAIN', NULL, 'SocketTimeoutException', NULL][k % 6 + 1] AS failure_reason,
  CASE WHEN k % 6 < 2 THEN CAST(pid AS VARCHAR) ELSE '?' END AS net_id, CASE WHEN k % 6 = 4 THEN pid END AS validation_time_ms FROM lines WHERE k % 6 < 5""")
register("probe_failures_by_host", "connectivity-check-probes", PROBE, ["source_id", "key", "n"], """
SELECT source_id, CASE WHEN k % 6 = 1 THEN 'host' || k ELSE 'h' || k END AS key, count(*) AS n FROM lines WHERE k % 6 IN (1, 3) GROUP BY 1, 2""", "failures_by_host")

DNS = [("NetdEventListenerService", "DNS Requested by {u}, 10{k}(com.app{k}), SUCCESS, {c}ms"), ("NetdEventListenerService", "DNS Requested by {u}, 10{k}(com.app{k}), TIMEOUT, {c}ms"),
       ("NetdEventListenerService", "DNS Requested by {u}, 10{k}(com.app{k}), SKIPPED"), ("NetdEventListenerService", "DNS Requested by nobody")]
register("dns_queries", "dns-query-events", DNS, ["source_id", "line_num", "net_id", "package", "uid", "result", "latency_ms"], """
SELECT source_id, line_num, CAST(pid AS VARCHAR) AS net_id, 'com.app' || k AS package, '10' || k AS uid, ['SUCCESS', 'TIMEOUT', 'SKIPPED'][k % 4 + 1] AS result,
  CASE WHEN k % 4 < 2 THEN cents ELSE 0 END AS latency_ms FROM lines WHERE k % 4 < 3""")
register("dns_query_summary", "dns-query-events", DNS, ["source_id", "total_queries", "queries_success", "queries_failed", "queries_skipped", "max_latency_ms", "min_latency_ms", "avg_latency_ms"], """
SELECT source_id, count(*) AS total_queries, count(*) FILTER (k % 4 = 0) AS queries_success, count(*) FILTER (k % 4 = 1) AS queries_failed, count(*) FILTER (k % 4 = 2) AS queries_skipped,
  max(cents) FILTER (k % 4 < 2) AS max_latency_ms, min(cents) FILTER (k % 4 < 2 AND cents > 0) AS min_latency_ms,
  sum(cents) FILTER (k % 4 < 2) / count(*) FILTER (k % 4 = 0) AS avg_latency_ms FROM lines WHERE k % 4 < 3 GROUP BY 1""", "summary")
register("dns_slow_queries", "dns-query-events", DNS, ["source_id", "key", "max"], """
SELECT source_id, 'com.app' || k || ' (net ' || pid || ')' AS key, max(cents) AS max FROM lines WHERE k % 4 < 2 AND cents > 500 GROUP BY 1, 2""", "slow_queries")

SERVER = [("", "DUMP OF SERVICE dnsresolver:"), ("", "    over UDP"), ("", "    1.2.3.{k} ({c}, {u}, 1, {k}, 0, {n}ms, 5s)"), ("", "      8.8.8.8:53 ({u}, {k}ms, [NOERROR:1]) score{4.5}"),
          ("", "    9.9.9.9 name{} status{success}"), ("", "    over TLS"), ("", "DUMP OF SERVICE wifi:"), ("", "retry_count: {k}")]
SERVER_SQL = """, x AS (SELECT *, k % 8 AS kind, coalesce(last_value(CASE k % 8 WHEN 0 THEN true WHEN 6 THEN false END IGNORE NULLS) OVER w, false) AS inside FROM lines
  WINDOW w AS (PARTITION BY source_id ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
y AS (SELECT *, last_value(CASE WHEN inside AND kind = 1 THEN 'UDP' WHEN inside AND kind = 5 THEN 'TLS' END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY line_num
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS proto FROM x)"""
register("dns_servers", "dns-server-stats", SERVER, ["source_id", "line_num", "record_type", "server", "protocol", "total", "timeouts", "rtt_avg_ms", "status"], SERVER_SQL + """
SELECT source_id, line_num, ['server_udp', 'server_proto_stats', 'dot_config'][kind - 1] AS record_type, CASE kind WHEN 2 THEN '1.2.3.' || k WHEN 3 THEN '8.8.8.8:53' ELSE '9.9.9.9' END AS server,
  CASE kind WHEN 2 THEN 'UDP' WHEN 3 THEN coalesce(proto, '?') ELSE 'DoT' END AS protocol, CASE kind WHEN 2 THEN cents WHEN 3 THEN pid END AS total, CASE kind WHEN 2 THEN k END AS timeouts,
  CASE kind WHEN 2 THEN line_num WHEN 3 THEN k END AS rtt_avg_ms, CASE kind WHEN 4 THEN 'success' END AS status FROM y WHERE inside AND kind IN (2, 3, 4)""")
register("dns_server_summary", "dns-server-stats", SERVER, ["source_id", "total_queries", "total_answered", "total_timeouts"], SERVER_SQL + """
SELECT source_id, coalesce(sum(cents) FILTER (kind = 2), 0)::BIGINT AS total_queries, coalesce(sum(pid) FILTER (kind = 2), 0)::BIGINT AS total_answered,
  coalesce(sum(k) FILTER (kind = 2), 0)::BIGINT AS total_timeouts FROM y WHERE inside AND kind IN (1, 2, 3, 4, 5, 7) GROUP BY 1""", "summary")
register("dns_experiments", "dns-server-stats", SERVER, ["source_id", "experiment", "value"], SERVER_SQL + """
SELECT source_id, 'retry_count' AS experiment, CAST(arg_max(k, line_num) AS VARCHAR) AS value FROM y WHERE inside AND kind = 7 GROUP BY 1""", "experiments")

PRIVATE = [("", "DUMP OF SERVICE dnsresolver:"), ("", "1:02:03.{k} - netId=1 PrivateDns={srv/1} state=in_process"), ("", "1:02:04.{k} - netId=1 PrivateDns={srv/1} state=success"),
           ("", "1:02:05.{k} - netId=1 PrivateDns={srv/1} state=fail"), ("", "PrivateDns={none")]
PRIVATE_SQL = """, x AS (SELECT source_id, line_num, k, k % 5 AS kind, bool_or(k % 5 = 0) OVER w AS inside FROM lines WINDOW w AS (PARTITION BY source_id ORDER BY line_num)),
y AS (SELECT *, lag(kind) OVER w AS pk, lag(k) OVER w AS pt FROM x WHERE inside AND kind IN (1, 2, 3) WINDOW w AS (PARTITION BY source_id ORDER BY line_num)),
z AS (SELECT *, CASE WHEN pk = 1 THEN (kind - 1) * 1000 + k - pt ELSE -1 END AS latency FROM y WHERE kind > 1)"""
register("private_dns_probes", "dns-private-probe-tracker", PRIVATE, ["source_id", "line_num", "net_id", "server", "result", "latency_ms"], PRIVATE_SQL + """
SELECT source_id, line_num, '1' AS net_id, 'srv' AS server, CASE kind WHEN 2 THEN 'success' ELSE 'fail' END AS result, latency AS latency_ms FROM z""")
register("private_dns_latency", "dns-private-probe-tracker", PRIVATE, ["source_id", "server", "avg_latency_ms"], PRIVATE_SQL + """
SELECT source_id, 'srv' AS server, (sum(latency) // count(*))::BIGINT AS avg_latency_ms FROM z WHERE latency >= 0 GROUP BY 1""", "latency_by_server")

# -- Wi-Fi ----------------------------------------------------------------------------------------

P2P = [("wpa_supplicant", "P2P-GO-NEG-SUCCESS role=GO freq={k} peer with aa:bb:cc:dd:ee:ff wps_method=PBC"), ("wpa_supplicant", "GO Negotiation with 11:22:33:44:55:66"),
       ("wpa_supplicant", "Was not expecting GO Negotiation Response"), ("wpa_supplicant", "P2P: Timeout (state=CONNECT)"),
       ("wpa_supplicant", "Provision Discovery Request TX callback: success=0"), ("wpa_supplicant", "Sending GO Negotiation Response status={k}")]
register("p2p_negotiation", "p2p-go-negotiation-events", P2P, ["source_id", "line_num", "event_type", "peer_mac", "freq", "role", "outcome"], """
SELECT source_id, line_num, ['go_neg_success', 'go_neg_started', 'unexpected_response', 'go_neg_timeout', 'provision_discovery_tx', 'go_neg_response_sending'][k % 6 + 1] AS event_type,
  CASE k % 6 WHEN 0 THEN 'aa:bb:cc:dd:ee:ff' WHEN 1 THEN '11:22:33:44:55:66' ELSE 'unknown' END AS peer_mac, CASE WHEN k % 6 = 0 THEN CAST(k AS VARCHAR) ELSE '' END AS freq,
  CASE WHEN k % 6 = 0 THEN 'GO' ELSE '' END AS role, CASE k % 6 WHEN 0 THEN 'success_as_GO' WHEN 2 THEN 'race_condition' WHEN 3 THEN 'timeout' WHEN 4 THEN 'tx_failed' WHEN 5 THEN 'status_' || k ELSE '' END AS outcome
FROM lines""")
register("p2p_summary", "p2p-go-negotiation-events", P2P, ["source_id", "total_negotiations", "successful", "failed", "race_conditions"], """
SELECT source_id, count(*) FILTER (k % 6 IN (0, 3)) AS total_negotiations, count(*) FILTER (k % 6 = 0) AS successful, count(*) FILTER (k % 6 = 3) AS failed,
  count(*) FILTER (k % 6 = 2) AS race_conditions FROM lines GROUP BY 1""", "summary")

WLAN = [("a", "CTRL-EVENT-DISCONNECTED bssid=aa:bb:cc:dd:ee:ff reason={k} locally_generated=1"), ("a", "wlan0: deauthenticating WLAN_REASON_DEAUTH LG: 1"),
        ("a", "NETWORK_DISCONNECTION_EVENT bssid: aa:bb:cc:dd:ee:00 reasonCode: {u} locallyGenerated: false ssid: \"net{k}\""), ("a", "NETWORK_DISCONNECTION_EVENT only")]
register("wlan_disconnects", "wlan-disconnect-events", WLAN, ["source_id", "line_num", "event_type", "reason", "lg", "bssid"], """
SELECT source_id, line_num, ['disconnect', 'deauth', 'disconnect'][k % 4 + 1] AS event_type, CASE k % 4 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN 'DEAUTH' ELSE CAST(pid AS VARCHAR) END AS reason,
  [-1, 1, 0][k % 4 + 1] AS lg, ['aa:bb:cc:dd:ee:ff', 'unknown', 'aa:bb:cc:dd:ee:00'][k % 4 + 1] AS bssid FROM lines WHERE k % 4 < 3""")


# -- trackers -------------------------------------------------------------------------------------

NONE = "∅"
# Per tracker: (expected rule or None, tag, message, section, expected new values as templates; None means back to the default).
BODY = "voltage:{c}, temperature:{u}, current_avg:-{k}"
STORIES = {
    "app-lifecycle": [
        ("Activity Started", "ActivityManager", "START u0 {cmp=com.a{k}/.Main{u} x}", None, {"foreground_app": "com.a{k}", "foreground_activity": ".Main{u}", "crashed": "false"}),
        ("App Crashed", "ActivityManager", "Process com.a{k} (pid {u}) has died", None, {"last_crash": "com.a{k}", "crashed": "true"}),
        ("ANR Detected", "ActivityManager", "ANR in com.a{u} now", None, {"last_crash": "com.a{u}", "crashed": "true"}),
        ("App Resumed", "ActivityManagerX", "Displayed com.b{k}/.Act: +1s", None, {"foreground_app": "com.b{k}", "foreground_activity": ".Act", "crashed": "false"}),
        (None, "Other", "ANR in com.x", None, {})],
    "battery-health": [
        ("Health Update", "PowerUI", "BATTERY_HEALTH_CHECK extraHealth={k}", None, {"health": "{k}"}),
        ("Protect Mode On", "AODBatteryManager", "saveBatteryData mBatteryProtectMode=true", None, {"protect_mode": "true"}),
        ("Protect Mode Off", "AODBatteryManager", "saveBatteryData mBatteryProtectMode=false", None, {"protect_mode": "false"}),
        ("Charger Type Update", "AODBatteryManager", "saveBatteryData mBatteryChargerType=FAST_ONE", None, {"charger_type": "FAST_ONE"}),
        ("Swelling Mode (AOD)", "AODBatteryManager", "saveBatteryData mBatterySwellingMode=HIGH", None, {"swelling_mode": "HIGH"}),
        ("Swelling Normal (PowerUI)", "PowerUI", "Battery swelling mode: mBatterySwellingMode = 0", None, {"swelling_mode": "NONE"}),
        ("Swelling Active (PowerUI)", "PowerUI", "Battery swelling mode: mBatterySwellingMode = 3", None, {"swelling_mode": "SWELLING"})],
    "battery-state": [
        ("Charging via USB (full)", "BatteryService", f"Sending ACTION_BATTERY_CHANGED: level:{{k}}, ac:false, usb:true, {BODY}, charge_type:1, charger_type:2, hvc:true", None,
         {"level": "{k}", "charging": "true", "status": "charging", "plugged": "usb", "voltage": "{c}", "temperature": "{u}", "current_avg": "-{k}", "charge_type": "1", "charger_type": "2", "hvc": "true"}),
        ("Charging via AC", "BatteryService", f"Sending ACTION_BATTERY_CHANGED: level:{{k}}, ac:true, {BODY}", None,
         {"level": "{k}", "charging": "true", "status": "charging", "plugged": "ac", "voltage": "{c}", "temperature": "{u}", "current_avg": "-{k}"}),
        ("Discharging", "BatteryService", f"Sending ACTION_BATTERY_CHANGED: level:{{k}}, status:3, {BODY}", None,
         {"level": "{k}", "charging": "false", "status": "discharging", "plugged": "none", "voltage": "{c}", "temperature": "{u}", "current_avg": "-{k}"}),
        ("Battery Full", "BatteryService", f"Sending ACTION_BATTERY_CHANGED: level:{{k}}, status:5, {BODY}", None,
         {"level": "{k}", "charging": "false", "status": "full", "voltage": "{c}", "temperature": "{u}", "current_avg": "-{k}"}),
        ("Battery Level (processValuesLocked)", "BatteryService", "[processValuesLocked]batteryLevel:{u}", None, {"level": "{u}"})],
    "cellular-registration-state": [
        ("Service State Changed (Full)", "PhoneStateTracker<1>", "mVoiceRegState=0(IN) mDataRegState=1(OUT) getRilDataRadioTechnology=14(LTE{k}) mOperatorAlphaLong=Op{u}, x", None,
         {"slot": "1", "voice_reg_state": "IN", "data_reg_state": "OUT", "rat": "LTE{k}", "operator": "Op{u}"}),
        ("Data RAT Changed", "VolteServiceModule", "getRilDataRadioTechnology=3(UMTS{k})", None, {"rat": "UMTS{k}"}),
        ("Voice In Service", "PhoneStateTracker<0>", "mVoiceRegState=0(IN_SERVICE)", None, {"slot": "0", "voice_reg_state": "IN_SERVICE"}),
        ("SST Combined Reg State", "SST", "updateOperatorName combinedRegState: {k}", "RADIO LOG", {"combined_reg_state": "{k}"}),
        ("NR State Change", "NetworkTypeController", "updateNrAdvancedState: a -> b{k}", "RADIO LOG", {"nr_state": "b{k}"}),
        (None, "SST", "updateOperatorName combinedRegState: 9", "SYSTEM LOG", {})],
    "memory-pressure": [
        ("Memory Pressure Event", "ChimeraAggressivePolicyHandler", "memAvailable: {c}, memFreeTarget: {u}, releaseTarget:{k}, protectedLruCount: 3", None,
         {"mem_available": "{c}", "mem_free_target": "{u}", "release_target": "{k}", "protected_lru_count": "3"}),
        ("LMKD Trigger", "ChimeraAggressivePolicyHandler", "executePolicy triggerSource: T{u}", None, {"trigger_source": "T{u}"})],
    "network-connectivity": [
        ("Network Validated", "ConnectivityService", "[{k} WIFI] validation passed", None, {"connected": "true", "validated": "true", "network_type": "WIFI"}),
        ("Network Validation Failed", "ConnectivityService", "[{k} CELL] validation failed", None, {"connected": "true", "validated": "false", "network_type": "CELL"}),
        ("Network Exiting", "ConnectivityService", "Update score for net {k} : +EXITING", None, {"connected": "false", "validated": "false", "network_type": None}),
        ("Network Exit Cancelled", "ConnectivityService", "Update score for net {k} : -EXITING", None, {"connected": "true"}),
        ("Network Capabilities Validated", "ConnectivityService", "Update capabilities for net 5 : +VALIDATED", None, {"validated": "true"}),
        ("Network Disconnected (Legacy)", "ConnectivityService", "type: WIFI[], state: DISCONNECTED/DISCONNECTED", None, {"connected": "false", "network_type": None})],
    "p2p-group-formation-tracker": [
        ("P2P Search Started", "wpa_supplicant", "State IDLE -> SEARCH", None, {"formation_state": "searching", "failure_reason": "none", "race_detected": "false"}),
        ("P2P Device Found", "WifiP2pService", "P2P_DEVICE_FOUND_EVENT Device: dev{k} x", None, {"formation_state": "device_found", "peer_device": "dev{k}"}),
        ("GO Negotiation Race Detected", "wpa_supplicant", "Was not expecting GO Negotiation Response", None, {"race_detected": "true"}),
        ("GO Neg Success - Local is GO", "wpa_supplicant", "P2P-GO-NEG-SUCCESS role=GO freq={k} peer_dev=aa:bb:cc:dd:ee:ff", None,
         {"formation_state": "provisioning", "role": "GO", "operating_freq": "{k}", "peer_mac": "aa:bb:cc:dd:ee:ff", "go_neg_status": "success"}),
        ("Group Removed", "WifiP2pService", "P2P_GROUP_REMOVED_EVENT", None, {"formation_state": "idle", "role": None, "peer_device": None, "peer_mac": None,
                                                                             "operating_freq": None, "group_interface": None, "ssid": None}),
        ("Group Interface Created", "wpa_supplicant", "Initializing interface 'p2p-wlan0-{k}' ", None, {"group_interface": "p2p-wlan0-{k}"})],
    "p2p-wps-provisioning-tracker": [
        ("EAP Identity", "wpa_supplicant", "EAP entering state IDENTITY", None, {"wps_state": "eap_identity", "eap_state": "IDENTITY"}),
        ("WPS M2 Received", "wpa_supplicant", "WPS: Received M2", None, {"wps_state": "m2_received"}),
        ("WPS M7 Sent", "wpa_supplicant", "WPS: Sending M7", None, {"wps_state": "m7_sent"}),
        ("WPS Failed", "wpa_supplicant", "WPS: it did Fail", None, {"wps_state": "failed", "failure_reason": "wps_failure"}),
        ("Interface Removed", "wpa_supplicant", "Remove interface p2p-wlan0-1 from radio", None, {"wps_state": "idle", "peer_mac": None, "eap_state": None,
                                                                                                "group_interface": None, "failure_reason": None})],
    "radio-airplane-mode-state": [
        ("Airplane On, Data Off", "MobileSignalController(1)", "airplaneMode=true,dataConnected=false,emergencyOnly=true,simCard=S{k}", None,
         {"airplane_mode": "true", "data_connected": "false", "emergency_only": "true", "sim_card_state": "S{k}"}),
        ("Airplane Off, Data Connected", "MobileSignalController(1)", "airplaneMode=false,dataConnected=true,emergencyOnly=false,simCard=R{u}", None,
         {"airplane_mode": "false", "data_connected": "true", "emergency_only": "false", "sim_card_state": "R{u}"}),
        ("Airplane Mode On (simple)", "MobileSignalController", "airplaneMode=true", None, {"airplane_mode": "true"}),
        ("Airplane Off + Emergency (partial)", "MobileSignalController", "airplaneMode=false emergencyOnly=true", None, {"airplane_mode": "false", "emergency_only": "true"})],
    "samsung-auto-blocker": [
        ("Auto Blocker On", "SecDynamicFragment", "rampart_main_setting_alias isCheck : true", None, {"enabled": "true", "source": "logcat"}),
        ("Auto Blocker Off", "SecDynamicFragment", "rampart_main_setting_alias isCheck : false", None, {"enabled": "false", "source": "logcat"}),
        ("Auto Blocker On (dumpstate, platform)", "", "rampart_main_setting_alias | Auto Blocker | x | 1 |", "APP PROVIDERS PLATFORM", {"enabled": "true", "source": "dumpstate"}),
        ("Auto Blocker Off (dumpstate, non-platform)", "", "rampart_main_setting_alias | Auto Blocker | x | 0 |", "APP PROVIDERS NON-PLATFORM", {"enabled": "false", "source": "dumpstate"})],
    "thermal-state": [
        ("Thermal Status", "", "Thermal Status: {k}", "thermalservice", {"thermal_status": "{k}"}),
        ("AP Temperature", "", "Temperature{mValue={k}.5, mType=0, mName=AP, x}", "thermalservice", {"temp_ap": "{k}.5"}),
        ("PATHM Temperature", "", "Temperature{mValue={u}.0, mName=PATHM}", "thermalservice", {"temp_pathm": "{u}.0"}),
        ("PA Temperature", "", "Temperature{mValue={u}.1, mName=PA}", "thermalservice", {"temp_pa": "{u}.1"}),
        ("CPU Count", "ThermalEngine", "Number of cpus :{k}", None, {"num_cpus": "{k}"}),
        (None, "", "Thermal Status: 99", "other", {})],
    "wifi-state": [
        ("WiFi Enabled", "WifiStateMachine", "CMD_ENABLE_NETWORK", None, {"enabled": "true"}),
        ("WiFi Connected", "WifiInfo", "SSID=net{k}, SignalLevel=-{u}", None, {"ssid": "net{k}", "signal_dbm": "-{u}"}),
        ("IP Assigned", "DhcpClient", "Confirmed new address 10.0.0.{k}", None, {"ip_address": "10.0.0.{k}"}),
        ("WiFi Disabled", "WifiStateMachine", "CMD_DISABLE_NETWORK", None, {"enabled": "false", "ssid": None, "signal_dbm": None, "ip_address": None}),
        ("WiFi Disconnected", "WifiStateMachine", "DISCONNECTING", None, {"ssid": "", "ip_address": None}),
        ("IP + Signal Connected (Samsung)", "ConnectivityService", "IP: /1.2.3.{k} RSSI: -{u}", None, {"ip_address": "1.2.3.{k}", "signal_dbm": "-{u}"})],
    "wlan-disconnect-tracker": [
        ("Disconnected (local, wpa_supplicant)", "w", "CTRL-EVENT-DISCONNECTED bssid=aa:bb:cc:dd:ee:ff reason=3 locally_generated=1", None,
         {"connection_state": "disconnecting", "bssid": "aa:bb:cc:dd:ee:ff", "locally_generated": "yes"}),
        ("Connected (wpa_supplicant)", "w", "CTRL-EVENT-CONNECTED to 11:22:33:44:55:66", None, {"connection_state": "connected", "bssid": "11:22:33:44:55:66", "last_reason": "", "locally_generated": ""}),
        ("Deauth (remote, named reason)", "w", "WLAN_REASON_R{k} LG: 0", None, {"connection_state": "disconnecting", "last_reason": "R{k}", "locally_generated": "no"}),
        ("Disconnected (AOSP)", "WifiClientModeImpl", "DisconnectedState.enter", None, {"connection_state": "disconnected"}),
        ("Disconnected (network event, local)", "x", "NETWORK_DISCONNECTION_EVENT bssid: aa:aa:aa:aa:aa:aa reasonCode: {k} locallyGenerated: true", "wifi",
         {"connection_state": "disconnected", "bssid": "aa:aa:aa:aa:aa:aa", "last_reason": "{k}", "locally_generated": "yes"}),
        ("Connecting (Samsung)", "SemClientModeImpl", "CMD_START_CONNECT", None, {"connection_state": "connecting"})],
}


def story_sql(tracker_id: str) -> str:
    """Expected changes: per field the latest told value before and at each matched line."""
    story, defaults = STORIES[tracker_id], JOBS[tracker_id].defaults
    text = lambda v: NONE if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    touched = [f for f in defaults if any(f in s[4] for s in story)]
    n = len(story)
    rule = "CASE k % {} {} END".format(n, " ".join(f"WHEN {i} THEN {told_sql(s[0])}" for i, s in enumerate(story) if s[0]))
    cols = []
    for f in touched:
        arms = [f"WHEN {i} THEN {told_sql(s[4][f]) if s[4][f] is not None else told_sql(text(defaults[f]))}" for i, s in enumerate(story) if f in s[4]]
        cols.append(f"CASE k % {n} {' '.join(arms)} END AS d_{f}")
    prev = [f"coalesce(last_value(d_{f} IGNORE NULLS) OVER w, {told_sql(text(defaults[f]))}) AS p_{f}" for f in touched]
    rows = [f"SELECT source_id, line_num, transition, '{f}' AS field, nullif(p_{f}, '{NONE}') AS from_value, nullif(coalesce(d_{f}, p_{f}), '{NONE}') AS to_value FROM p"
            for f in touched]
    return with_lines(f""", m AS (SELECT source_id, line_num, {rule} AS transition, {', '.join(cols)} FROM lines),
p AS (SELECT *, {', '.join(prev)} FROM m WHERE transition IS NOT NULL
  WINDOW w AS (PARTITION BY source_id ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS ({' UNION ALL '.join(rows)}) SELECT * FROM f WHERE from_value IS DISTINCT FROM to_value""")


def _register_tracker(tracker_id: str) -> None:
    texts = [(s[1], s[2], s[3]) for s in STORIES[tracker_id]]

    def run(spark, sf):
        return flat_changes(JOBS[tracker_id].run(tell(spark, sf, texts))).select(
            "source_id", "line_num", "transition", "field", "from_value", "to_value")
    query("tracker_" + tracker_id.replace("-", "_"), story_sql(tracker_id))(run)


for _t in STORIES:
    _register_tracker(_t)


@query("job_insights", with_lines("""
, s AS (SELECT source_id, 'large_kill' AS name, 'warning' AS severity, line_num AS line, 'large_kill: process_name=com.app' || k || ', pid=' || pid || ', rss_kb=' || cents || '00, reason=idle' AS message
  FROM lines WHERE k % 2 = 0 AND cents * 100 > 100000
UNION ALL SELECT source_id, 'kill_storm', 'critical', min(line_num), 'kill_storm: total_kills=' || count(*) || ', total_rss_freed_kb=' || sum(cents) * 100 FROM lines WHERE k % 2 = 0
  GROUP BY 1 HAVING count(*) > 50)
SELECT source_id, name, severity, line, message FROM s QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY severity, line) <= 20"""))
def job_insights(spark, sf):
    texts = [("ActivityManager", "Killing {u}:com.app{k}/u0 #{k} idle adj=9 rss={c}00kb"), ("ActivityManager", "other")]
    j = JOBS["process-kill-storm"]
    return j.insights(j.run(tell(spark, sf, texts))).select("source_id", "name", "severity", "line", "message")


@query("job_charts", with_lines("""
SELECT 'kill_timeline' AS chart_id, ts_ns - ts_ns % 60000000000 AS x, CAST(sum(cents) AS DOUBLE) AS y, NULL AS label FROM lines WHERE k % 2 = 0 GROUP BY 2
UNION ALL SELECT 'top_killed_by_rss', row_number() OVER (ORDER BY sum(cents) DESC, 'com.app' || k) - 1, sum(cents), 'com.app' || k FROM lines WHERE k % 2 = 0 GROUP BY k"""))
def job_charts(spark, sf):
    texts = [("ActivityManager", "Killing {u}:com.app{k}/u0 #{k} idle adj=9 rss={c}kb"), ("ActivityManager", "other")]
    j = JOBS["process-kill-storm"]
    return j.draw(j.run(tell(spark, sf, texts))).select("chart_id", "x", "y", "label")


@query("job_summary_text", with_lines("""
SELECT source_id, 'total_crashes=' || count(*) AS summary FROM lines WHERE k % 3 = 0 GROUP BY 1"""))
def job_summary_text(spark, sf):
    j = JOBS["crash-storm-detector"]
    return j.summary_text(j.run(tell(spark, sf, CRASH, "Error")))


PACK = [CRASH[0], ("ActivityManager", "Killing {u}:com.app{k}/u0 #{k} idle adj=9 rss={c}kb"), ("Comp", "java.lang.Kind{k}Exception: gone"), ("Comp", "nothing")]


@query("pack_summary", with_lines("""
SELECT ['crash-storm-detector', 'process-kill-storm', 'exception-stack-tracker'][k % 4 + 1] AS job, count(*) AS n FROM lines WHERE k % 4 < 3 GROUP BY 1"""))
def pack_summary(spark, sf):
    """Result rows of the stability pack's reporters over crashes, kills, exceptions and other lines."""
    out = run_pack("stability-monitor", tell(spark, sf, PACK, "Error"))
    parts = [out[j]["emissions"].agg(F.count("*").alias("n")).select(F.lit(j).alias("job"), "n")
             for j in ("crash-storm-detector", "process-kill-storm", "exception-stack-tracker")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
