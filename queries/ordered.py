"""Ordered and stateful operators: bursts, trackers, correlation, carried values, traces, downsampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from linespark.functions import predicates as P
from linespark.functions.extract import extract_fields, field
from linespark.operators import charts, ordered, sections, setops, stateful, tracker, traces
from linespark.operators.correlate import Source, correlate, correlation_matches
from linespark.operators.tracker import Rule
from linespark.plans.stability import fd_exhaustion

from .adapters import EVENT_SECTIONS, LINES, event_lines, with_lines
from .registry import query

# Small blocks make the checked scales cross many block edges.
BLOCK = 512
HOUR_MS = 3_600_000

BURST = """b AS (SELECT source_id, line_num, tag, ts_ns, lag(line_num) OVER (PARTITION BY source_id ORDER BY line_num) AS prev_line,
    row_number() OVER (PARTITION BY source_id, tag ORDER BY line_num) AS rn FROM lines),
c AS (SELECT *, rn - min(rn) OVER (PARTITION BY source_id, tag ORDER BY ts_ns RANGE BETWEEN {w} PRECEDING AND CURRENT ROW) + 1 AS cnt FROM b),
h AS (SELECT *, cnt >= {t} AS hot, coalesce(lag(cnt >= {t}) OVER (PARTITION BY source_id, tag ORDER BY rn), false) AS was FROM c)"""


@query("burst_detect", f"""WITH {LINES}, {BURST.format(w=6 * HOUR_MS * 10**6, t=5)}
SELECT source_id, tag AS burst_key, cnt AS count_in_window, CAST({6 * HOUR_MS} AS BIGINT) AS window_ms, coalesce(prev_line, 0) AS line_num, ts_ns
FROM h WHERE hot AND NOT was""")
def burst_detect(spark, sf):
    return stateful.burst_detect(event_lines(spark, sf), "tag", 6 * HOUR_MS, 5, block_lines=BLOCK)


@query("burst_detect_current_line", f"""WITH {LINES}, {BURST.format(w=24 * HOUR_MS * 10**6, t=20)}
SELECT source_id, tag AS burst_key, cnt AS count_in_window, CAST({24 * HOUR_MS} AS BIGINT) AS window_ms, line_num, ts_ns
FROM h WHERE hot AND NOT was""")
def burst_detect_current_line(spark, sf):
    return stateful.burst_detect(event_lines(spark, sf), "tag", 24 * HOUR_MS, 20, line="current", block_lines=BLOCK)


SHAKEN = """s AS (SELECT source_id, tag || k % 4 AS key, line_num, ts_ns + ((line_num * 7919) % 13 - 6) * 3600000000000 AS t,
  row_number() OVER (PARTITION BY source_id, tag || k % 4 ORDER BY line_num) AS i FROM lines),
q AS (SELECT source_id, key, i, i AS front FROM s WHERE i = 1
  UNION ALL SELECT n.source_id, n.key, n.i, min(o.i) FROM q JOIN s n ON n.source_id = q.source_id AND n.key = q.key AND n.i = q.i + 1
  JOIN s o ON o.source_id = q.source_id AND o.key = q.key AND o.i >= q.front AND o.i <= n.i AND o.t >= n.t - {w} GROUP BY ALL),
h AS (SELECT s.*, s.i - q.front + 1 AS cnt, coalesce(lag(s.i - q.front + 1) OVER (PARTITION BY s.source_id, s.key ORDER BY s.i), 0) AS was
  FROM s JOIN q USING (source_id, key, i))"""


@query("burst_detect_times_backwards", f"""WITH RECURSIVE {LINES}, {SHAKEN.format(w=12 * HOUR_MS * 10**6)}
SELECT source_id, key AS burst_key, cnt AS count_in_window, line_num, t AS ts_ns FROM h WHERE cnt >= 4 AND was < 4""")
def burst_detect_times_backwards(spark, sf):
    """Times shaken by up to six hours; the SQL drops and counts the queue event by event."""
    x = event_lines(spark, sf).withColumn("ts_ns", F.col("ts_ns") + ((F.col("line_num") * 7919) % 13 - 6) * F.lit(HOUR_MS * 10**6))
    key = F.concat("tag", (F.col("tid") % 4).cast("string"))
    return stateful.burst_detect(x, key, 12 * HOUR_MS, 4, line="current", block_lines=BLOCK).select("source_id", "burst_key", "count_in_window", "line_num", "ts_ns")


@query("matched_pairs", with_lines(""", m AS (SELECT source_id, line_num, tag = 'click' AS opens FROM lines WHERE tag IN ('click', 'purchase')),
r AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER (PARTITION BY source_id ORDER BY line_num) AS run FROM m),
o AS (SELECT *, run - least(0, min(run) OVER (PARTITION BY source_id ORDER BY line_num)) AS open FROM r),
d AS (SELECT *, CASE WHEN opens THEN open ELSE coalesce(lag(open) OVER (PARTITION BY source_id ORDER BY line_num), 0) END AS depth FROM o),
p AS (SELECT *, lag(line_num) OVER w AS start_line, lag(opens) OVER w AS after_open FROM d WHERE depth > 0 WINDOW w AS (PARTITION BY source_id, depth ORDER BY line_num))
SELECT source_id, 'visit' AS name, start_line, line_num AS end_line FROM p WHERE NOT opens AND after_open"""))
def matched_pairs(spark, sf):
    """Every click opens and every purchase closes the latest open one: one name for all of a source."""
    marks = event_lines(spark, sf).filter(F.col("tag").isin("click", "purchase")).withColumn("name", F.lit("visit"))
    return sections.matched_pairs(marks, ["source_id", "name"], F.col("tag") == "click", BLOCK)


@query("sections_over_whole_sources", with_lines(""", last AS (SELECT source_id, max(line_num) AS last FROM lines GROUP BY 1),
z AS (SELECT source_id, line_num AS start_line, last + line_num % 3 * 1000000 AS end_line FROM lines JOIN last USING (source_id) WHERE line_num % 211 = 0
  UNION ALL SELECT source_id, 0, 1000000000000 FROM last)
SELECT z.source_id, z.start_line, z.end_line, count(*) AS n, max(line_num) AS last_line FROM lines l JOIN z ON z.source_id = l.source_id AND l.line_num BETWEEN z.start_line AND z.end_line
GROUP BY ALL"""))
def sections_over_whole_sources(spark, sf):
    """Nested ranges that all reach the end of their source or far beyond."""
    x = event_lines(spark, sf)
    last = x.groupBy("source_id").agg(F.max("line_num").alias("_last"))
    some = x.filter("line_num % 211 = 0").join(last, "source_id").select("source_id", F.col("line_num").alias("start_line"), (F.col("_last") + F.col("line_num") % 3 * 1000000).alias("end_line"))
    whole = last.select("source_id", F.lit(0).cast("bigint").alias("start_line"), F.lit(10**12).alias("end_line"))
    return sections.summarize_ranges(x, some.unionByName(whole), {"n": F.lit(1).cast("bigint")}, {"last_line": F.col("line_num")}, block=64)


def tracker_rules():
    return [
        Rule("failed", P.tag_prefix("error") & P.message_regex(r"k=[1-4]"), {"status": "bad", "who": field(r"user=(\d+)")}),
        Rule("paid", P.tag_prefix("purchase"), {"status": "good"}, ("who",)),
        Rule("ignored", P.tag_prefix("error"), {}),
        Rule("joined", P.tag_prefix("signup") & P.message_contains("k=5"), {"flagged": True, "who": field(r"user=(\d+)")}),
    ]


DEFAULTS = {"status": "new", "who": None, "flagged": False}

TRACK = """r AS (SELECT source_id, line_num, ts_ns, CAST(pid AS VARCHAR) AS u, CASE
    WHEN starts_with(tag, 'error') AND regexp_matches(message, 'k=[1-4]') THEN 0 WHEN starts_with(tag, 'purchase') THEN 1
    WHEN starts_with(tag, 'error') THEN 2 WHEN starts_with(tag, 'signup') AND contains(message, 'k=5') THEN 3 END AS rule FROM lines),
q AS (SELECT source_id, line_num, ts_ns, rule, CASE rule WHEN 0 THEN 'bad' WHEN 1 THEN 'good' END AS d_status,
    CASE WHEN rule IN (0, 3) THEN u WHEN rule = 1 THEN '' END AS d_who, CASE rule WHEN 3 THEN 'true' END AS d_flag FROM r WHERE rule IS NOT NULL),
p AS (SELECT *, coalesce(last_value(d_status IGNORE NULLS) OVER w, 'new') AS was_status,
    nullif(last_value(d_who IGNORE NULLS) OVER w, '') AS was_who, coalesce(last_value(d_flag IGNORE NULLS) OVER w, 'false') AS was_flag
  FROM q WINDOW w AS (PARTITION BY source_id ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT source_id, line_num, ts_ns, rule, 'status' AS field, was_status AS from_value, coalesce(d_status, was_status) AS to_value FROM p
  UNION ALL SELECT source_id, line_num, ts_ns, rule, 'who', was_who, CASE WHEN d_who IS NULL THEN was_who ELSE nullif(d_who, '') END FROM p
  UNION ALL SELECT source_id, line_num, ts_ns, rule, 'flagged', was_flag, coalesce(d_flag, was_flag) FROM p),
tr AS (SELECT source_id, line_num, ts_ns, CASE rule WHEN 0 THEN 'failed' WHEN 1 THEN 'paid' WHEN 2 THEN 'ignored' ELSE 'joined' END AS transition,
    field, from_value, to_value FROM f WHERE from_value IS DISTINCT FROM to_value)"""


def transitions(spark, sf):
    return tracker.track_state(event_lines(spark, sf), tracker_rules(), DEFAULTS, "shop", BLOCK)


@query("track_state", f"WITH {LINES}, {TRACK} SELECT source_id, 'shop' AS tracker, line_num, ts_ns, transition, field, from_value, to_value FROM tr")
def track_state(spark, sf):
    return tracker.flat_changes(transitions(spark, sf)).select(
        "source_id", "tracker", "line_num", "ts_ns", "transition", "field", "from_value", "to_value")


@query("transition_lines", f"WITH {LINES}, {TRACK} SELECT DISTINCT source_id, 'shop' AS tracker, line_num FROM tr")
def transition_lines(spark, sf):
    return tracker.transition_lines(transitions(spark, sf))


@query("recent_transitions", f"""WITH {LINES}, {TRACK} SELECT DISTINCT source_id, line_num, transition FROM tr
  ORDER BY line_num DESC LIMIT 25""")
def recent_transitions(spark, sf):
    return tracker.recent_transitions(transitions(spark, sf), 25).select("source_id", "line_num", "transition")


@query("state_intervals", f"""WITH {LINES}, {TRACK}
SELECT source_id, 'status' AS field, to_value AS value, line_num AS start_line, lead(line_num) OVER w AS end_line,
  lead(ts_ns) OVER w - ts_ns AS duration_ns FROM tr WHERE field = 'status' WINDOW w AS (PARTITION BY source_id ORDER BY line_num)""")
def state_intervals(spark, sf):
    return tracker.state_intervals(transitions(spark, sf), "status", BLOCK).select(
        "source_id", "field", "value", "start_line", "end_line", "duration_ns")


@query("state_at", f"""WITH {LINES}, {TRACK}, pt AS (SELECT source_id, line_num FROM lines),
latest AS (SELECT pt.source_id, pt.line_num, field, arg_max_null(to_value, tr.line_num) AS v, max(tr.line_num) AS seen_at FROM pt JOIN tr
  ON pt.source_id = tr.source_id AND tr.line_num <= pt.line_num GROUP BY 1, 2, 3),
wide AS (SELECT pt.source_id, pt.line_num, max(v) FILTER (field = 'status') AS s, max(v) FILTER (field = 'who') AS who,
  max(v) FILTER (field = 'flagged') AS f, count(field) AS n, coalesce(max(seen_at), 0) AS seen_at
  FROM pt LEFT JOIN latest ON pt.source_id = latest.source_id AND pt.line_num = latest.line_num GROUP BY 1, 2)
SELECT source_id, line_num, coalesce(s, 'new') AS status, who, coalesce(f, 'false') AS flagged, n AS known, seen_at AS state_line FROM wide""")
def state_at(spark, sf):
    points = event_lines(spark, sf).select("source_id", "line_num")
    got = tracker.state_at(transitions(spark, sf), points, DEFAULTS, block_lines=BLOCK)
    return got.select("source_id", "line_num", "status", "who", "flagged", F.size("initialized_fields").cast("bigint").alias("known"), "state_line")


@query("final_state", f"""WITH {LINES}, {TRACK}
SELECT source_id, coalesce(max_by(to_value, line_num) FILTER (field = 'status'), 'new') AS status,
  max_by(coalesce(to_value, ''), line_num) FILTER (field = 'who') AS who, coalesce(max_by(to_value, line_num) FILTER (field = 'flagged'), 'false') AS flagged
FROM tr GROUP BY source_id""")
def final_state(spark, sf):
    return tracker.final_state(transitions(spark, sf), DEFAULTS).select("source_id", "status", F.coalesce("who", F.lit("")).alias("who"), "flagged")


@query("mask_transitions", f"""WITH {LINES}, {TRACK}
SELECT source_id, line_num, field, CASE WHEN from_value IN ('12', '7', '33') THEN '<ID-' || from_value || '>' ELSE from_value END AS from_value,
  CASE WHEN to_value IN ('12', '7', '33') THEN '<ID-' || to_value || '>' ELSE to_value END AS to_value FROM tr""")
def mask_transitions(spark, sf):
    ids = event_lines(spark, sf).filter(F.col("pid").isin(7, 12, 33)).select(F.col("pid").cast("string").alias("raw")).distinct()
    pii_map = ids.withColumn("token", F.concat(F.lit("<ID-"), "raw", F.lit(">")))
    return tracker.flat_changes(tracker.mask_transitions(transitions(spark, sf), pii_map)).select(
        "source_id", "line_num", "field", "from_value", "to_value")


CORR = """x AS (SELECT source_id, line_num, ts_ns, pid, tag = 'error' AS trig, tag = 'purchase' AND cents > 20000 AS cause FROM lines
  WHERE tag = 'error' OR (tag = 'purchase' AND cents > 20000)),
g AS (SELECT *, coalesce(sum(CASE WHEN trig THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY line_num
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM x),
m AS (SELECT t.source_id, t.line_num AS trigger_line, t.pid AS t_pid, c.line_num, c.pid AS c_pid FROM g t JOIN g c
  ON t.trig AND c.cause AND t.source_id = c.source_id AND t.grp = c.grp AND c.line_num < t.line_num
  AND t.line_num - c.line_num <= 40 AND t.ts_ns - c.ts_ns <= 10800000000000)"""


def corr_sources():
    user = {"user": field(r"user=(\d+)")}
    cents = field(r"cents=(\d+)", "int")
    return (Source("err", P.tag_prefix("error"), user),
            Source("buy", P.tag_prefix("purchase"), {**user, "cents": cents}, lambda f: f["cents"] > 20000))


@query("correlate", f"""WITH {LINES}, {CORR}
SELECT source_id, trigger_line, count(*) AS matches, max(line_num) AS latest_line,
  'user ' || any_value(t_pid) || ' after ' || arg_max(c_pid, line_num) || ' {{{{buy.none}}}}' AS message FROM m GROUP BY 1, 2""")
def correlate_q(spark, sf):
    trigger, cause = corr_sources()
    out = correlate(event_lines(spark, sf), trigger, [cause], within_lines=40, within_ms=3 * HOUR_MS,
                    emit="user {{err.user}} after {{buy.user}} {{buy.none}}", block_lines=BLOCK)
    return out.select("source_id", "trigger_line", "matches", F.col("latest_buy.line_num").alias("latest_line"), "message")


@query("correlation_matches", f"WITH {LINES}, {CORR} SELECT source_id, trigger_line, line_num FROM m")
def correlation_matches_q(spark, sf):
    trigger, cause = corr_sources()
    return correlation_matches(event_lines(spark, sf), trigger, [cause], 40, 3 * HOUR_MS, block_lines=BLOCK).select(
        "source_id", "trigger_line", "line_num")


def _both_kinds(first: str, later: str) -> str:
    """Trigger: error or purchase; cause: purchase or signup; a purchase line is both, and ``first`` is handled first."""
    return f""", x AS (SELECT source_id, line_num, ts_ns, 0 AS o, '{first}' AS kind FROM lines WHERE tag IN {('error', 'purchase') if first == 't' else ('purchase', 'signup')}
  UNION ALL SELECT source_id, line_num, ts_ns, 1, '{later}' FROM lines WHERE tag IN {('error', 'purchase') if later == 't' else ('purchase', 'signup')}),
n AS (SELECT *, first_value(CASE WHEN kind = 't' THEN line_num END IGNORE NULLS) OVER w AS trigger_line, first_value(CASE WHEN kind = 't' THEN ts_ns END IGNORE NULLS) OVER w AS t
  FROM x WINDOW w AS (PARTITION BY source_id ORDER BY line_num, o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT source_id, trigger_line, line_num FROM n WHERE kind = 'c' AND trigger_line - line_num <= 30 AND t - ts_ns <= 7200000000000"""


def _lines_that_are_both(spark, sf, trigger_first):
    trigger, cause = Source("t", P.tag_prefix("error", "purchase")), Source("c", P.tag_prefix("purchase", "signup"))
    return correlation_matches(event_lines(spark, sf), trigger, [cause], 30, 2 * HOUR_MS, trigger_first, block_lines=BLOCK).select("source_id", "trigger_line", "line_num")


@query("correlate_both_trigger_first", with_lines(_both_kinds("t", "c")))
def correlate_both_trigger_first(spark, sf):
    return _lines_that_are_both(spark, sf, True)


@query("correlate_both_cause_first", with_lines(_both_kinds("c", "t")))
def correlate_both_cause_first(spark, sf):
    return _lines_that_are_both(spark, sf, False)


@query("correlate_several_causes", f"""WITH RECURSIVE {LINES}, x AS (SELECT source_id, line_num, ts_ns, pid, CASE WHEN tag = 'error' THEN 'err' WHEN tag = 'signup' THEN 'join' ELSE 'buy' END AS kind
  FROM lines WHERE tag IN ('error', 'signup') OR (tag = 'purchase' AND cents > 20000)),
p AS (SELECT *, last_value(CASE WHEN kind = 'buy' THEN line_num END IGNORE NULLS) OVER w AS b, last_value(CASE WHEN kind = 'buy' THEN ts_ns END IGNORE NULLS) OVER w AS bt,
  last_value(CASE WHEN kind = 'join' THEN line_num END IGNORE NULLS) OVER w AS j, last_value(CASE WHEN kind = 'join' THEN ts_ns END IGNORE NULLS) OVER w AS jt
  FROM x WINDOW w AS (PARTITION BY source_id ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
able AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY line_num) AS i FROM p WHERE kind = 'err' AND line_num - least(b, j) <= 60 AND b IS NOT NULL AND j IS NOT NULL AND ts_ns - least(bt, jt) <= {12 * HOUR_MS * 10**6}),
r AS (SELECT DISTINCT source_id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS last, CAST(-1 AS BIGINT) AS before, false AS fired FROM able
  UNION ALL SELECT a.source_id, a.i, CASE WHEN least(a.b, a.j) > r.last THEN a.line_num ELSE r.last END, r.last, least(a.b, a.j) > r.last FROM r JOIN able a ON a.source_id = r.source_id AND a.i = r.i + 1),
t AS (SELECT a.*, r.before FROM r JOIN able a USING (source_id, i) WHERE r.fired),
m AS (SELECT t.source_id, t.line_num AS trigger_line, t.pid AS err, c.kind, c.line_num, c.pid FROM t JOIN x c ON c.source_id = t.source_id AND c.kind <> 'err' AND c.line_num > t.before
  AND c.line_num < t.line_num AND t.line_num - c.line_num <= 60 AND t.ts_ns - c.ts_ns <= {12 * HOUR_MS * 10**6})
SELECT source_id, trigger_line, count(*) AS matches, count(*) FILTER (WHERE kind = 'buy') AS n_buy, count(*) FILTER (WHERE kind = 'join') AS n_join,
  any_value(err) || ': ' || arg_max(pid, line_num) FILTER (WHERE kind = 'buy') || ', ' || arg_max(pid, line_num) FILTER (WHERE kind = 'join') AS message FROM m GROUP BY 1, 2""")
def correlate_several(spark, sf):
    trigger, cause = corr_sources()
    join = Source("join", P.tag_prefix("signup"), {"user": field(r"user=(\d+)")})
    out = correlate(event_lines(spark, sf), trigger, [cause, join], within_lines=60, within_ms=12 * HOUR_MS,
                    emit="{{err.user}}: {{buy.user}}, {{join.user}}", block_lines=BLOCK)
    return out.select("source_id", "trigger_line", "matches", "n_buy", "n_join", "message")


@query("carry_forward", with_lines("""
SELECT source_id, line_num, last_value(CASE WHEN tag = 'signup' THEN pid END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY line_num
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_joined FROM lines"""))
def carry_forward(spark, sf):
    joined = F.when(F.col("tag") == "signup", F.col("pid"))
    return stateful.carry_forward(event_lines(spark, sf), joined, "last_joined", block_lines=BLOCK).select("source_id", "line_num", "last_joined")


@query("gate_between", with_lines("""
SELECT source_id, line_num, coalesce(last_value(CASE WHEN tag = 'error' THEN false WHEN tag = 'signup' THEN true END IGNORE NULLS) OVER (
  PARTITION BY source_id ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS in_gate FROM lines"""))
def gate_between(spark, sf):
    out = stateful.gate_between(event_lines(spark, sf), F.col("tag") == "signup", F.col("tag") == "error", block_lines=BLOCK)
    return out.select("source_id", "line_num", "in_gate")


PAIRS = """pr AS (SELECT source_id, line_num, pid, ts_ns, tag, lag(tag) OVER w AS pt, lag(ts_ns) OVER w AS pts, lag(line_num) OVER w AS pl
  FROM lines WHERE tag IN ('click', 'purchase') WINDOW w AS (PARTITION BY source_id, pid ORDER BY line_num)),
ends AS (SELECT source_id, line_num, pid, CASE WHEN pt = 'click' THEN pl END AS start_line,
  CASE WHEN pt = 'click' THEN ts_ns // 1000000 - pts // 1000000 ELSE -1 END AS latency FROM pr WHERE tag = 'purchase')"""


def paired(spark, sf):
    x = event_lines(spark, sf).withColumn("ms", F.expr("ts_ns div 1000000"))
    return stateful.pair_events(x, F.col("pid"), F.col("tag") == "click", F.col("tag") == "purchase", "ms", block_lines=BLOCK)


@query("pair_events", f"WITH {LINES}, {PAIRS} SELECT * FROM ends")
def pair_events(spark, sf):
    return paired(spark, sf).select("source_id", "line_num", "pid", "start_line", "latency")


@query("running_avg", with_lines("""
SELECT source_id, line_num, round(avg(cents) OVER (PARTITION BY source_id, tag ORDER BY line_num), 6) AS so_far FROM lines"""))
def running_avg(spark, sf):
    x = extract_fields(event_lines(spark, sf), {"cents": (r"cents=(\d+)", "int")})
    out = stateful.running_avg(x, "tag", "cents", "so_far", block_lines=BLOCK)
    return out.select("source_id", "line_num", F.round("so_far", 6).alias("so_far"))


@query("on_change", with_lines("""
SELECT source_id, line_num, tag FROM (SELECT *, lag(tag) OVER (PARTITION BY source_id, pid ORDER BY line_num) AS p,
  lag(line_num) OVER (PARTITION BY source_id, pid ORDER BY line_num) AS pl FROM lines) WHERE pl IS NULL OR p IS DISTINCT FROM tag"""))
def on_change(spark, sf):
    return stateful.on_change(event_lines(spark, sf), "pid", "tag", block_lines=BLOCK).select("source_id", "line_num", "tag")


@query("lookback", with_lines("""
SELECT source_id, line_num, array_to_string(list_reverse(list(line_num) OVER (PARTITION BY source_id ORDER BY line_num
  ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)), ',') AS seen FROM lines WHERE tag = 'error'"""))
def lookback(spark, sf):
    x = event_lines(spark, sf).filter("tag = 'error'")
    out = stateful.lookback(x, 5, ("line_num",), block_lines=BLOCK)
    ids = F.transform("history", lambda h: h.line_num.cast("string"))
    return out.select("source_id", "line_num", F.when(F.size(ids) > 0, F.array_join(ids, ",")).alias("seen"))


@query("lookback_extract", with_lines("""
SELECT source_id, line_num, found, found_line FROM (SELECT source_id, line_num, tag,
  last_value(CASE WHEN tag = 'purchase' THEN cents END IGNORE NULLS) OVER w AS found,
  last_value(CASE WHEN tag = 'purchase' THEN line_num END IGNORE NULLS) OVER w AS found_line FROM lines
  WINDOW w AS (PARTITION BY source_id ORDER BY line_num RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING)) WHERE tag = 'error'"""))
def lookback_extract(spark, sf):
    cents = field(r"cents=(\d+)", "int")
    out = stateful.lookback_extract(event_lines(spark, sf), F.col("tag") == "error", F.col("tag") == "purchase", 12, cents, block_lines=BLOCK)
    return out.select("source_id", "line_num", "found", "found_line")


@query("delta_between", with_lines("""
SELECT source_id, CASE WHEN min(line_num) FILTER (k = 20) > min(line_num) FILTER (k = 10)
  THEN arg_min(cents, line_num) FILTER (k = 20) - arg_min(cents, line_num) FILTER (k = 10) END AS delta FROM lines WHERE k IN (10, 20) GROUP BY 1"""))
def delta_between(spark, sf):
    x = extract_fields(event_lines(spark, sf), {"cents": (r"cents=(\d+)", "int")})
    return stateful.delta_between(x, F.col("tid"), 10, 20, "cents")


@query("rank_lines", with_lines("""
SELECT source_id, tag, line_num, row_number() OVER (PARTITION BY source_id, tag ORDER BY line_num) - 1 AS rank FROM lines"""))
def rank_lines(spark, sf):
    return ordered.rank_lines(event_lines(spark, sf).select("source_id", "tag", "line_num"), keys=("source_id", "tag"), block_lines=BLOCK)


@query("lag_rows", with_lines("""
SELECT source_id, line_num, lag(line_num, 3) OVER (PARTITION BY source_id, tag ORDER BY line_num) AS third_before FROM lines"""))
def lag_rows(spark, sf):
    x = event_lines(spark, sf).select("source_id", "tag", "line_num")
    return ordered.lag_rows(x, {"third_before": (F.col("line_num"), 3)}, keys=("source_id", "tag"), block_lines=BLOCK).drop("tag")


@query("out_of_order", with_lines("""
SELECT source_id, line_num FROM (SELECT *, (ts_ns // 1000) % 1000003 * 7919 % 1000003 AS t2 FROM lines) QUALIFY t2 < max(t2) OVER (
  PARTITION BY source_id ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def out_of_order(spark, sf):
    x = event_lines(spark, sf).withColumn("ts_ns", F.expr("(ts_ns div 1000) % 1000003 * 7919 % 1000003"))
    return ordered.out_of_order(x, block_lines=BLOCK).select("source_id", "line_num")


TRACE_TEXT = """CASE WHEN tag = 'error' AND k < 20 THEN 'FATAL EXCEPTION: thread-' || (k % 3)
  WHEN tag = 'error' AND k < 50 THEN 'Process: app.p' || (pid % 5) || ', PID: ' || pid
  WHEN tag = 'click' THEN 'java.lang.Kind' || (k % 4) || 'Exception: x'
  WHEN tag = 'view' AND k < 40 THEN 'Caused by: java.io.Root' || (k % 3) || 'Error'
  WHEN tag = 'view' THEN 'at com.app.m' || (k % 3) || '.Main.run'
  ELSE 'nothing special' END"""


def trace_lines(spark, sf):
    """Events told as stack-trace lines: header, process, exception, cause and frame lines under three tags."""
    x = event_lines(spark, sf)
    k, t = F.col("tid"), F.col("tag")
    text = (F.when((t == "error") & (k < 20), F.concat(F.lit("FATAL EXCEPTION: thread-"), k % 3))
            .when((t == "error") & (k < 50), F.concat(F.lit("Process: app.p"), F.col("pid") % 5, F.lit(", PID: "), "pid"))
            .when(t == "click", F.concat(F.lit("java.lang.Kind"), k % 4, F.lit("Exception: x")))
            .when((t == "view") & (k < 40), F.concat(F.lit("Caused by: java.io.Root"), k % 3, F.lit("Error")))
            .when(t == "view", F.concat(F.lit("at com.app.m"), k % 3, F.lit(".Main.run"))).otherwise("nothing special"))
    tag = F.when(F.col("line_num") % 10 < 6, "AndroidRuntime").when(F.col("line_num") % 10 < 9, "System.err").otherwise("Other")
    return x.withColumns({"message": text, "tag": tag})


TRACES = f"""z AS (SELECT source_id, line_num, CASE WHEN line_num % 10 < 6 THEN 'AndroidRuntime'
    WHEN line_num % 10 < 9 THEN 'System.err' ELSE 'Other' END AS tag2, {TRACE_TEXT} AS m FROM lines),
x AS (SELECT *, nullif(regexp_extract(m, 'FATAL EXCEPTION: (.+)', 1), '') AS thread, nullif(regexp_extract(m, 'Process: ([^ ,]+)', 1), '') AS app,
    nullif(regexp_extract(m, '(java[.a-zA-Z0-9]*(Exception|Error))', 1), '') AS exc, nullif(regexp_extract(m, 'Caused by: (java[.a-zA-Z0-9]*Error)', 1), '') AS cause,
    nullif(regexp_extract(m, '^at ([a-z0-9.]+)[.]Main', 1), '') AS frame FROM z),
k AS (SELECT *, CASE WHEN thread IS NOT NULL THEN 'open' WHEN app IS NULL AND tag2 != 'AndroidRuntime' THEN 'break' END AS mark FROM x),
s AS (SELECT *, last_value(mark IGNORE NULLS) OVER w AS pm, last_value(CASE WHEN mark IS NOT NULL THEN line_num END IGNORE NULLS) OVER w AS pl FROM k
  WINDOW w AS (PARTITION BY source_id ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN mark = 'open' THEN line_num WHEN mark IS NULL AND pm = 'open' THEN pl END AS tr FROM s),
n AS (SELECT a.source_id, a.line_num AS tr, min(b.line_num) AS close FROM k a JOIN k b ON a.mark = 'open' AND b.mark IS NOT NULL
  AND a.source_id = b.source_id AND b.line_num > a.line_num GROUP BY 1, 2),
a AS (SELECT source_id, tr, max(thread) AS crash_thread, arg_max(app, line_num) FILTER (app IS NOT NULL) AS app,
  arg_min(exc, line_num) FILTER (exc IS NOT NULL AND app IS NULL AND thread IS NULL) AS exc,
  arg_max(cause, line_num) FILTER (cause IS NOT NULL AND app IS NULL AND thread IS NULL) AS cause FROM t WHERE tr IS NOT NULL GROUP BY 1, 2)"""
STDERR_TRACES = """r AS (SELECT *, tag2 = 'System.err' AS err, tag2 = 'System.err' AND exc IS NOT NULL AND cause IS NULL AS head FROM t WHERE tr IS NULL),
s2 AS (SELECT *, last_value(CASE WHEN head OR NOT err THEN head END IGNORE NULLS) OVER w AS open2,
    last_value(CASE WHEN head OR NOT err THEN line_num END IGNORE NULLS) OVER w AS line2,
    min(CASE WHEN head OR NOT err THEN line_num END) OVER (PARTITION BY source_id ORDER BY line_num ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS close2
  FROM r WINDOW w AS (PARTITION BY source_id ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t2 AS (SELECT *, CASE WHEN head THEN line_num WHEN err AND open2 THEN line2 END AS tr2 FROM s2),
a2 AS (SELECT source_id, tr2, max(exc) FILTER (head) AS exc, arg_max(cause, line_num) FILTER (cause IS NOT NULL AND NOT head) AS cause,
  arg_min(frame, line_num) FILTER (frame IS NOT NULL AND NOT head AND cause IS NULL) AS frame, max(close2) FILTER (head) AS close
  FROM t2 WHERE tr2 IS NOT NULL GROUP BY 1, 2),
em AS (SELECT a.source_id, n.close AS line_num, app AS source, coalesce(exc, '') AS exception, coalesce(cause, exc, '') AS root_cause, crash_thread,
    a.tr AS start_line, true AS fatal FROM a JOIN n ON a.source_id = n.source_id AND a.tr = n.tr WHERE app IS NOT NULL
  UNION ALL SELECT source_id, close, coalesce(frame, 'System.err'), exc, coalesce(cause, exc), '', tr2, false FROM a2 WHERE close IS NOT NULL
  UNION ALL SELECT source_id, line_num, tag2, exc, exc, '', line_num, false FROM r WHERE NOT err AND exc IS NOT NULL AND cause IS NULL AND frame IS NULL)"""


@query("group_traces_fatal", f"""WITH {LINES}, {TRACES}
SELECT a.source_id, n.close AS line_num, app AS source, coalesce(exc, '') AS exception, coalesce(cause, exc, '') AS root_cause, crash_thread,
  a.tr AS start_line FROM a JOIN n ON a.source_id = n.source_id AND a.tr = n.tr WHERE app IS NOT NULL""")
def group_traces_fatal(spark, sf):
    t = traces.group_traces(trace_lines(spark, sf), BLOCK)
    return t.emissions.filter("fatal").select("source_id", "line_num", "source", "exception", "root_cause", "crash_thread", "start_line")


@query("group_traces", f"""WITH {LINES}, {TRACES}, {STDERR_TRACES}
SELECT em.*, ts_ns FROM em JOIN lines USING (source_id, line_num)""")
def group_traces(spark, sf):
    return traces.group_traces(trace_lines(spark, sf), BLOCK).emissions


@query("group_traces_summary", f"""WITH {LINES}, {TRACES}, {STDERR_TRACES}
SELECT a.source_id, app AS name, arg_max(coalesce(exc, '') || CASE WHEN cause != coalesce(exc, '') THEN ' (root: ' || cause || ')' ELSE '' END
    || ' on ' || crash_thread, a.tr) AS detail, CAST(1 AS BIGINT) AS n
  FROM a LEFT JOIN n ON a.source_id = n.source_id AND a.tr = n.tr WHERE app IS NOT NULL AND (n.close IS NOT NULL OR exc IS NOT NULL) GROUP BY 1, 2
UNION ALL SELECT source_id, source || ': ' || exception, '', count(*) FROM em WHERE NOT fatal GROUP BY source_id, source, exception""")
def group_traces_summary(spark, sf):
    t = traces.group_traces(trace_lines(spark, sf), BLOCK)
    return t.fatal.select("source_id", F.col("app").alias("name"), "detail", F.lit(1).cast("bigint").alias("n")).unionByName(
        t.nonfatal.select("source_id", F.concat_ws(": ", "source", "exception").alias("name"), F.lit("").alias("detail"), "n"))


@query("lttb", f"""WITH RECURSIVE {LINES},
p AS (SELECT source_id, line_num AS x, CAST(cents AS DOUBLE) AS y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY source_id) AS total
  FROM lines WHERE cents IS NOT NULL WINDOW w AS (PARTITION BY source_id ORDER BY line_num)),
g AS (SELECT *, (total - 2) / 98.0::DOUBLE AS size FROM p WHERE total > 100),
d AS (SELECT source_id, x, y, i, b FROM g, range(98) r(b) WHERE i >= floor(b * size + 1) AND i < floor((b + 1) * size + 1) AND i < total - 1
  UNION ALL SELECT source_id, x, y, i, CASE WHEN i = 0 THEN -1 ELSE 98 END FROM g WHERE i IN (0, total - 1)),
c AS (SELECT source_id, b, avg(x) AS ax, avg(y) AS ay FROM d GROUP BY ALL),
walk AS (SELECT source_id, b, x, y FROM d WHERE b = -1
  UNION ALL SELECT source_id, b, best.x, best.y FROM (
    SELECT d.source_id, d.b, max({{'area': abs((w.x - c.ax) * (d.y - w.y) - (w.x - d.x) * (c.ay - w.y)), 'i': -d.i, 'x': d.x, 'y': d.y}}) AS best
    FROM walk w JOIN d ON d.source_id = w.source_id AND d.b = w.b + 1 AND d.b < 98 JOIN c ON c.source_id = d.source_id AND c.b = d.b + 1 GROUP BY 1, 2)),
ends AS (SELECT source_id, x, y FROM walk UNION ALL SELECT source_id, x, y FROM d WHERE b = 98 UNION ALL SELECT source_id, x, y FROM p WHERE total <= 100)
SELECT ends.*, min_y, max_y FROM ends JOIN (SELECT source_id, min(y) AS min_y, max(y) AS max_y FROM p GROUP BY 1) USING (source_id)""")
def lttb(spark, sf):
    x = extract_fields(event_lines(spark, sf), {"y": (r"cents=(\d+)", "int")})
    return charts.lttb(x, "line_num", "y", 100, block_lines=8 * BLOCK)


@query("minmax_downsample", with_lines("""
, p AS (SELECT source_id, line_num AS x, CAST(cents AS DOUBLE) AS y, min(line_num) OVER (PARTITION BY source_id) AS lo,
  max(line_num) OVER (PARTITION BY source_id) AS hi FROM lines),
b AS (SELECT *, least(CAST(floor((x - lo) * 50 / (hi - lo + 1)) AS BIGINT), 49) AS b FROM p)
SELECT DISTINCT source_id, x, y FROM (SELECT source_id, b, x, y FROM b QUALIFY row_number() OVER (PARTITION BY source_id, b ORDER BY y, x) = 1
  UNION ALL SELECT source_id, b, x, y FROM b QUALIFY row_number() OVER (PARTITION BY source_id, b ORDER BY y DESC, x) = 1)"""))
def minmax_downsample(spark, sf):
    x = extract_fields(event_lines(spark, sf), {"y": (r"cents=(\d+)", "int")})
    return charts.minmax_downsample(x, "line_num", "y", 50)


@query("timeline_index", with_lines("""
SELECT source_id, line_num, row_number() OVER (ORDER BY ts_ns, source_id, line_num) - 1 AS position FROM lines"""))
def timeline_index(spark, sf):
    x = event_lines(spark, sf).select("source_id", "line_num", "ts_ns")
    parts = [x.filter(F.col("source_id") == str(i)) for i in range(4)]
    return setops.timeline_index(setops.merge_sources(*parts)).select("source_id", "line_num", "position")


@query("timeline_range", with_lines("""
SELECT source_id, line_num FROM lines WHERE ts_ns BETWEEN 1704200000000000000 AND 1704900000000000000"""))
def timeline_range(spark, sf):
    x = event_lines(spark, sf).select("source_id", "line_num", "ts_ns")
    tl = setops.timeline(x.filter("source_id = '0'"), x.filter("source_id != '0'"))
    return setops.timeline_range(tl, 1704200000000000000, 1704900000000000000).select("source_id", "line_num")


@query("cross_query", with_lines("""
SELECT source_id, line_num FROM lines WHERE tag IN ('error', 'purchase') AND source_id IN ('1', '3') AND level_ord >= 3
  AND ts_ns >= 1704200000000000000 ORDER BY ts_ns, source_id, line_num LIMIT 200"""))
def cross_query(spark, sf):
    return setops.cross_query(event_lines(spark, sf), 1704200000000000000, None, ["error", "purchase"], ["1", "3"], "W", 200).select(
        "source_id", "line_num")
