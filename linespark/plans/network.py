"""Network: connectivity probes, DNS queries, DNS servers, private DNS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.extract import extract_fields
from ..functions.predicates import message_contains, message_contains_any, tag_prefix
from ..functions.scalars import hms_ms
from ..operators.aggregate import average, count_map, counter, last_value, max_map, running_max, running_min, summarize, total
from ..operators.charts import Chart
from ..operators.insights import Signal
from ..operators.project import emit
from ..operators.stateful import carry_forward, gate_between, pair_events, running_avg
from .base import Job, has, orelse

# Fixed values throughout this module: tags, message texts, field patterns and labels of the log formats.
PROBE = {
    "probe": r"(PROBE_DNS|PROBE_HTTPS|PROBE_HTTP|PROBE_FALLBACK|isCaptivePortal)", "dns_host": r"PROBE_DNS (\S+) ",
    "dns_ms": (r"PROBE_DNS \S+ (\d+)ms", "int"), "dns_result": r"PROBE_DNS \S+ \d+ms (OK|FAIL)",
    "dns_ips": r"PROBE_DNS \S+ \d+ms OK (.+)", "dns_detail": r"PROBE_DNS \S+ \d+ms FAIL(?:\s+in type \S+\s+)?(.*)",
    "http_url": r"PROBE_(?:HTTPS?|FALLBACK) (\S+) time=", "http_ms": (r"time=(\d+)ms", "int"),
    "http_ret": (r"ret=(\d+)", "int"), "fail_url": r"PROBE_(?:HTTPS?|FALLBACK) (\S+) Probe failed",
    "exc": r"exception (java\.net\.\w+):", "exc_detail": r"exception java\.net\.\w+: (.+)",
    "ok": r"isSuccessful\(\)=(true|false)", "portal": r"isPortal\(\)=(true|false)",
    "partial": r"isPartialConnectivity\(\)=(true|false)", "check_ms": (r"Time=(\d+)ms", "int"),
    "redirect": r"RedirectUrl=(\S+)",
}


def probes(lines: DataFrame) -> dict[str, DataFrame]:
    x = extract_fields(lines, PROBE)
    kind = (F.when(F.col("dns_result").isNotNull(), F.when(F.col("dns_result") == "OK", "dns_ok").otherwise("dns_fail"))
            .when(F.col("http_ret").isNotNull(), "http_ok").when(F.col("exc").isNotNull(), "http_fail")
            .when(F.col("ok").isNotNull(), "verdict"))
    x = x.withColumn("_k", kind)
    k = lambda *v: F.col("_k").isin(*v)
    short = F.replace(orelse("probe", "PROBE_HTTP"), F.lit("PROBE_"), F.lit(""))
    dns_why = (F.when(F.col("dns_detail").contains("ErrnoException"), "DNS Resolver Error")
               .when(F.col("dns_detail").contains("UnknownHost"), "DNS NXDOMAIN").otherwise("DNS Timeout"))
    http_why = F.replace("exc", F.lit("java.net."), F.lit(""))
    url = F.when(k("http_ok"), F.col("http_url")).when(k("http_fail"), orelse("fail_url", "unknown"))
    verdict = (F.when(F.col("ok") == "true", "validated").when(F.col("portal") == "true", "portal")
               .when(F.col("partial") == "true", "partial").otherwise("failed"))
    net = F.when(F.col("tag").contains("/"), F.split_part("tag", F.lit("/"), F.lit(2))).otherwise("?")
    rows = emit(
        x.filter("_k IS NOT NULL"), probe_type=F.when(k("dns_ok", "dns_fail"), "DNS").when(k("verdict"), "VERDICT").otherwise(short),
        host=F.when(k("dns_ok"), F.col("dns_host")).when(k("dns_fail"), orelse("dns_host", "unknown")),
        url=url, duration_ms=F.when(k("dns_ok", "dns_fail"), F.col("dns_ms")).when(k("http_ok"), F.col("http_ms")),
        result=F.when(k("dns_ok", "http_ok"), "OK").when(k("dns_fail", "http_fail"), "FAIL").otherwise(verdict),
        resolved_ips=F.when(k("dns_ok"), F.col("dns_ips")), ret_code=F.when(k("http_ok"), F.col("http_ret")),
        failure_reason=F.when(k("dns_fail"), dns_why).when(k("http_fail"), http_why),
        detail=F.when(k("dns_fail"), orelse("dns_detail", "")).when(k("http_fail"), orelse("exc_detail", "")),
        validation_time_ms=F.when(k("verdict"), orelse("check_ms", 0)),
        redirect_url=F.when(k("verdict"), orelse("redirect", "")), net_id=net)
    plain = lambda *v: k(*v) & short.isin("HTTP", "FALLBACK")
    tls = lambda *v: k(*v) & (short == "HTTPS")
    summary = summarize(x, {
        "total_probes": counter(F.col("probe").isNotNull()), "dns_ok": counter(k("dns_ok")), "dns_fail": counter(k("dns_fail")),
        "http_ok": counter(plain("http_ok")), "http_fail": counter(plain("http_fail")), "https_ok": counter(tls("http_ok")),
        "https_fail": counter(tls("http_fail")),
        **{n: counter(k("verdict") & (verdict == v)) for n, v in (
            ("validation_pass", "validated"), ("validation_fail", "failed"), ("validation_partial", "partial"),
            ("portal_detected", "portal"))}})
    fails = rows.filter((F.col("result") == "FAIL") & F.col("failure_reason").isNotNull())
    after = F.when(F.col("url").contains("://"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
                   ).otherwise(F.col("url"))
    return {"emissions": rows, "summary": summary, "failures_by_type": count_map(fails, "failure_reason"),
            "failures_by_host": count_map(fails, F.coalesce("host", after))}


QUERY = {
    "net": r"DNS Requested by (\d+),", "uid": r"DNS Requested by \d+,\s*(\d+)\(",
    "pkg": r"DNS Requested by \d+,\s*\d+\(([^)]+)\)", "ms": (r",\s*(\d+)ms\s*$", "int"),
}
OUTCOMES = ("SUCCESS", "FAIL", "SKIPPED", "TIMEOUT")


def dns_queries(lines: DataFrame) -> dict[str, DataFrame]:
    raw = F.col("raw")
    result = None
    for o in OUTCOMES:
        c = raw.contains(f"), {o},") | raw.endswith(f"), {o}")
        result = F.when(c, o) if result is None else result.when(c, o)
    x = extract_fields(lines, QUERY).withColumn("result", result).filter("result IS NOT NULL")
    rows = emit(x, net_id=orelse("net", "?"), package=orelse("pkg", "unknown"), uid=orelse("uid", ""), result=F.col("result"),
                latency_ms=orelse("ms", 0))
    timed, good = F.col("latency_ms") > 0, F.col("result") == "SUCCESS"
    bad = ~F.col("result").isin("SUCCESS", "SKIPPED")
    main = summarize(rows, {
        "total_queries": counter(), "queries_success": counter(good), "queries_failed": counter(bad),
        "queries_skipped": counter(F.col("result") == "SKIPPED"), "total_latency_ms": total("latency_ms"),
        "max_latency_ms": running_max("latency_ms", 0), "min_latency_ms": running_min(F.when(timed, F.col("latency_ms")), 999999),
        "_timed": F.max(F.when(timed, F.col("line_num")))})
    # The average divides by the successes seen up to the last timed query.
    seen = rows.join(main.select("source_id", "_timed"), "source_id").filter(good & (F.col("line_num") <= F.col("_timed")))
    seen = seen.groupBy("source_id").agg(F.count("*").alias("_ok"))
    avg = F.when(F.col("_timed").isNotNull(), F.col("total_latency_ms") / F.coalesce(F.col("_ok"), F.lit(1))).otherwise(F.lit(0.0))
    summary = main.join(seen, "source_id", "left").withColumn("avg_latency_ms", avg).drop("_timed", "_ok")
    slow = F.concat(F.col("package"), F.lit(" (net "), F.col("net_id"), F.lit(")"))
    return {"emissions": rows, "summary": summary, "queries_by_app": count_map(rows, "package"),
            "failures_by_app": count_map(rows.filter(bad), "package"), "queries_by_net": count_map(rows, "net_id"),
            "slow_queries": max_map(rows.filter("latency_ms > 500"), slow, "latency_ms")}


SERVER_MARKS = (
    "DUMP OF SERVICE dnsresolver", "Private DNS mode:", "search domains:", "DNS servers:", "over UDP", "over DOH", "over TLS",
    "over TCP", "DoT configuration", "DoH configuration", "name{} status{", "url{", "score{", "<no data> score{", "ms, ",
    "DUMP OF SERVICE ", "Experiments list", "doh_", "dot_", "keep_listening_udp", "max_cache_entries", "max_queries_global",
    "mdns_resolution", "no_retry_after_cancel", "parallel_lookup_sleep_time", "retransmission_time_interval", "retry_count",
    "sort_nameservers", "fail_fast_on_uid",
)
EXPERIMENT = r"^(?:doh_|dot_|fail_fast|keep_|max_|mdns_|no_retry|parallel_|retransmission_|retry_|sort_)"
SERVER = {
    "mode": r"Private DNS mode:\s*(\w+)", "domains": r"search domains:\s*(.+)", "proto": r"^\s{4}over\s+(UDP|DOH|TLS|TCP|MDNS)\s*$",
    "srv_ip": r"^\s{4}([\d.]+)\s+\(\d+", "srv_total": (r"^\s{4}[\d.]+\s+\((\d+),", "int"),
    "srv_answered": (r"^\s{4}[\d.]+\s+\(\d+,\s*(\d+),", "int"), "srv_errors": (r"^\s{4}[\d.]+\s+\(\d+,\s*\d+,\s*(\d+),", "int"),
    "srv_timeouts": (r"^\s{4}[\d.]+\s+\(\d+,\s*\d+,\s*\d+,\s*(\d+),", "int"),
    "srv_rtt": (r"^\s{4}[\d.]+\s+\(\d+,\s*\d+,\s*\d+,\s*\d+,\s*\d+,\s*(\d+)ms", "int"),
    "stat_server": r"^\s{6}([\d.]+:\d+)\s+\(\d+", "stat_total": (r"^\s{6}[\d.]+:\d+\s+\((\d+),", "int"),
    "stat_rtt": (r"^\s{6}[\d.]+:\d+\s+\(\d+,\s*(\d+)ms", "int"),
    "stat_rcodes": r"^\s{6}[\d.]+:\d+\s+\(\d+,\s*\d+ms,\s*\[([^\]]+)\]", "stat_score": r"score\{([\d.]+)\}",
    "dot_ip": r"^\s{4}([\d.]+)\s+name\{[^}]*\}\s+status\{(?:success|fail)\}",
    "dot_result": r"^\s{4}[\d.]+\s+name\{[^}]*\}\s+status\{(success|fail)\}",
    "doh_server": r"^\s{4}([\d.]+:\d+)\s+url\{", "doh_url": r"url\{([^}]+)\}", "doh_result": r"status\{(success|fail)\}",
}
RESOLVER, ANY_DUMP = "DUMP OF SERVICE dnsresolver", "DUMP OF SERVICE "


def _resolver_lines(lines: DataFrame) -> DataFrame:
    """Lines of the resolver's dump, without the dump headers."""
    raw = F.col("raw")
    gated = gate_between(lines, raw.contains(RESOLVER), raw.contains(ANY_DUMP) & ~raw.contains(RESOLVER), "_in")
    return gated.filter(F.col("_in") & ~raw.contains(ANY_DUMP)).drop("_in")


def dns_servers(lines: DataFrame) -> dict[str, DataFrame]:
    x = extract_fields(_resolver_lines(lines), SERVER)
    there = lambda c: F.col(c).isNotNull()
    text = F.trim("message")
    kind = (F.when(there("mode"), "mode").when(there("domains"), "domains").when(there("proto"), "proto")
            .when(there("srv_ip") & there("srv_total") & there("srv_rtt") & ~there("stat_server"), "server_udp")
            .when(there("stat_server") & there("stat_total"), "server_proto_stats").when(there("dot_ip"), "dot_config")
            .when(there("doh_server") & there("doh_result"), "doh_config")
            .when(text.rlike(EXPERIMENT) & text.contains(":"), "experiment"))
    x = x.withColumn("record_type", kind).filter("record_type IS NOT NULL")
    x = carry_forward(x, F.when(F.col("record_type") == "proto", F.col("proto")), "_proto")
    k = lambda *v: F.col("record_type").isin(*v)
    drop = F.when(F.col("srv_total") > 0, orelse("srv_timeouts", 0) / F.col("srv_total") * 100.0).otherwise(F.lit(0.0))
    rows = emit(
        x.filter(k("server_udp", "server_proto_stats", "dot_config", "doh_config")), record_type=F.col("record_type"),
        server=F.when(k("server_udp"), F.col("srv_ip")).when(k("server_proto_stats"), F.col("stat_server"))
        .when(k("dot_config"), F.col("dot_ip")).otherwise(F.col("doh_server")),
        protocol=F.when(k("server_udp"), "UDP").when(k("server_proto_stats"), orelse("_proto", "?"))
        .when(k("dot_config"), "DoT").otherwise("DoH"),
        total=F.when(k("server_udp"), F.col("srv_total")).when(k("server_proto_stats"), F.col("stat_total")),
        answered=F.when(k("server_udp"), orelse("srv_answered", 0)), errors=F.when(k("server_udp"), orelse("srv_errors", 0)),
        timeouts=F.when(k("server_udp"), orelse("srv_timeouts", 0)),
        rtt_avg_ms=F.when(k("server_udp"), F.col("srv_rtt")).when(k("server_proto_stats"), orelse("stat_rtt", 0)),
        drop_rate_pct=F.when(k("server_udp"), drop),
        rcodes=F.when(k("server_proto_stats"), orelse("stat_rcodes", "")),
        score=F.when(k("server_proto_stats"), orelse("stat_score", "")), url=F.when(k("doh_config"), orelse("doh_url", "")),
        status=F.when(k("dot_config"), F.col("dot_result")).when(k("doh_config"), F.col("doh_result")))
    udp = lambda c: total(F.when(k("server_udp"), F.col(c)))
    summary = summarize(x, {
        "private_dns_mode": orelse(last_value(F.when(k("mode"), F.col("mode"))), ""),
        "search_domains": orelse(last_value(F.when(k("domains"), F.col("domains"))), ""),
        "total_queries": udp("srv_total"), "total_answered": udp("srv_answered"), "total_errors": udp("srv_errors"),
        "total_timeouts": udp("srv_timeouts")})
    summary = summary.withColumn("drop_rate_pct", F.when(
        F.col("total_queries") > 0, F.col("total_timeouts") / F.col("total_queries") * 100.0).otherwise(F.lit(0.0)))
    latest = lambda df, key, cols: df.groupBy("source_id", *key).agg(
        F.max_by(F.struct(*cols), "line_num").alias("_l")).select("source_id", *key, "_l.*")
    exp = x.filter(k("experiment")).select(
        "source_id", "line_num", F.trim(F.split_part(text, F.lit(":"), F.lit(1))).alias("experiment"),
        F.trim(F.split_part(text, F.lit(":"), F.lit(2))).alias("value"))
    of = lambda v: rows.filter(F.col("record_type") == v)
    return {"emissions": rows, "summary": summary,
            "server_summary": latest(of("server_udp"), ["server"], ["total", "answered", "errors", "timeouts", "rtt_avg_ms", "drop_rate_pct"]),
            "dot_status": latest(of("dot_config"), ["server"], ["status"]),
            "doh_status": latest(of("doh_config"), ["server", "url"], ["status"]),
            "experiments": latest(exp, ["experiment"], ["value"])}


PRIVATE = {
    "net": r"netId=(\d+)", "server": r"PrivateDns=\{([^/}]+)", "state": r"state=(\w+)",
    "h": (r"^\s*(\d+):\d+:\d+\.\d+", "int"), "m": (r"^\s*\d+:(\d+):\d+\.\d+", "int"),
    "s": (r"^\s*\d+:\d+:(\d+)\.\d+", "int"), "ms": (r"^\s*\d+:\d+:\d+\.(\d+)", "int"),
}


def private_dns(lines: DataFrame) -> dict[str, DataFrame]:
    x = extract_fields(_resolver_lines(lines), PRIVATE).filter("state IS NOT NULL AND server IS NOT NULL")
    x = x.withColumns({"net_id": orelse("net", "?"), "_clock": orelse(hms_ms(F.col("h"), F.col("m"), F.col("s"), F.col("ms")), 0)})
    started = F.col("state") == "in_process"
    ends = pair_events(x, F.concat("net_id", F.lit(":"), F.col("server")), started, ~started, "_clock")
    ends = ends.withColumn("latency_ms", F.when(F.col("latency") >= 0, F.col("latency")).otherwise(F.lit(-1)))
    rows = emit(ends, net_id=F.col("net_id"), server=F.col("server"), result=F.col("state"), latency_ms=F.col("latency_ms"))
    good = F.col("result") == "success"
    timed = rows.filter("latency_ms >= 0")
    return {"emissions": rows, "failures_by_server": count_map(rows.filter(~good), "server", name="server"),
            "latency_by_server": timed.groupBy("source_id", "server").agg(
                average(F.sum("latency_ms"), F.count("*")).alias("avg_latency_ms")),
            "latency_trend": running_avg(timed, "server", "latency_ms", "avg_so_far"),
            "summary": summarize(rows, {"total_probes": counter(), "probes_success": counter(good), "probes_failed": counter(~good)})}


JOBS = [
    Job("connectivity-check-probes", lambda: tag_prefix("NetworkMonitor") & message_contains_any(
        "PROBE_DNS", "PROBE_HTTP", "PROBE_HTTPS", "PROBE_FALLBACK", "isCaptivePortal"), probes, ("SYSTEM LOG",),
        charts=(Chart("probe_outcomes", "bar", x="probe_type"), Chart("probe_latency", "time_series", y="duration_ms", agg="avg")),
        signals=lambda: [
            Signal("dns_failure", "warning", (F.col("result") == "FAIL") & (F.col("probe_type") == "DNS"),
                   fields=("probe_type", "host", "failure_reason", "detail")),
            Signal("validation_failed", "warning", (F.col("result") == "failed") & (F.col("probe_type") == "VERDICT"),
                   fields=("probe_type", "result", "net_id")),
            Signal("portal_detected", "warning", F.col("portal_detected") > 0, "aggregate", ("portal_detected",)),
            Signal("captive_portal_redirect", "warning", (F.col("result") == "portal") & (F.col("probe_type") == "VERDICT"),
                   fields=("probe_type", "result", "redirect_url", "net_id"))]),
    Job("dns-query-events", lambda: tag_prefix("NetdEventListenerService") & message_contains("DNS Requested by"), dns_queries,
        charts=(Chart("dns_latency_timeline", "time_series", y="latency_ms", agg="avg"),
                Chart("dns_queries_by_app", "bar", x="package"), Chart("dns_queries_by_net", "bar", x="net_id")),
        signals=lambda: [
            Signal("dns_query_failed", "warning", ~F.col("result").isin("SUCCESS", "SKIPPED"),
                   fields=("net_id", "package", "result", "latency_ms")),
            Signal("slow_dns_query", "info", (F.col("latency_ms") > 500) & (F.col("result") == "SUCCESS"),
                   fields=("net_id", "package", "latency_ms"))]),
    Job("dns-server-stats", lambda: message_contains_any(*SERVER_MARKS), dns_servers, ("DUMPSYS NORMAL",), ("bugreport",),
        charts=(Chart("dns_rtt_by_server", "bar", x="server", y="rtt_avg_ms", agg="avg"),
                Chart("dns_drop_rate", "bar", x="server", y="timeouts", agg="sum")),
        signals=lambda: [
            Signal("dns_timeouts", "warning", (F.col("timeouts") > 0) & (F.col("record_type") == "server_udp"),
                   fields=("server", "total", "timeouts", "drop_rate_pct")),
            Signal("dot_fail", "warning", (F.col("status") == "fail") & (F.col("record_type") == "dot_config"),
                   fields=("server", "status"))]),
    Job("dns-private-probe-tracker", lambda: message_contains_any(RESOLVER, ANY_DUMP, "PrivateDns={"), private_dns,
        ("DUMPSYS NORMAL",), ("bugreport",),
        charts=(Chart("probe_latency", "time_series", y="latency_ms", agg="avg"), Chart("probe_outcomes", "bar", x="server")),
        signals=lambda: [Signal("repeated_dot_failure", "warning", F.col("result") == "fail",
                                fields=("net_id", "server", "result", "latency_ms"))]),
]
