"""Line-by-line folds written from the operator descriptions: the oracle for the ordered operators."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession

LINE = ("source_id string, source_type string, line_num long, ts_ns long, level string, level_ord byte, tag string, pid int, "
        "tid int, message string, raw string")


def lines(spark: SparkSession, rows) -> DataFrame:
    """Rows are ``(source, line, ts_ns, tag, message)`` or dicts."""
    out = []
    for r in rows:
        if not isinstance(r, dict):
            r = dict(zip(("source_id", "line_num", "ts_ns", "tag", "message"), r))
        out.append((r.get("source_id", ""), r.get("source_type", "Logcat"), r["line_num"], r.get("ts_ns"), r.get("level", "Info"),
                    r.get("level_ord", 2), r.get("tag", ""), r.get("pid", 0), r.get("tid", 0), r.get("message", ""),
                    r.get("raw", r.get("message", ""))))
    return spark.createDataFrame(out, LINE)


def bursts(rows, window_ns: int, threshold: int):
    """``rows`` in line order: (source, line, ts, key)."""
    seen, hot, last, out = {}, set(), {}, []
    for src, line, ts, key in rows:
        key = key or "_default"
        q = seen.setdefault((src, key), deque())
        while q and ts - q[0] > window_ns:
            q.popleft()
        q.append(ts)
        if len(q) >= threshold:
            if (src, key) not in hot:
                hot.add((src, key))
                out.append((src, key, len(q), last.get(src, 0), ts))
        else:
            hot.discard((src, key))
        last[src] = line
    return out


def transitions(rows, rules, defaults):
    """``rules``: (name, predicate(row), set(row) -> dict, clear)."""
    state, out = {}, []
    for row in rows:
        cur = state.setdefault(row[0], dict(defaults))
        for name, when, values, clear in rules:
            if not when(row):
                continue
            new = {**cur, **values(row), **{f: defaults[f] for f in clear}}
            out += [(row[0], row[1], name, f, cur[f], new[f]) for f in defaults if cur[f] != new[f]]
            state[row[0]] = new
            break
    return out


def correlations(rows, order, trigger, within_lines, within_ns):
    """``rows`` in line order: (source, line, ts, set of kinds); ``order`` lists kinds as declared."""
    held, out = {}, []
    for src, line, ts, kinds in rows:
        buf = held.setdefault(src, {k: [] for k in order if k != trigger})
        for k in order:
            if k not in kinds:
                continue
            if k != trigger:
                buf[k].append((line, ts))
                continue
            for c in buf:
                buf[c] = [(l, t) for l, t in buf[c] if (within_lines is None or line - l <= within_lines)
                          and (within_ns is None or ts - t <= within_ns)]
            if buf and all(buf.values()):
                out += [(src, line, c, l) for c, rs in buf.items() for l, _ in rs]
                for c in buf:
                    buf[c] = []
    return out


def lttb(points, n):
    total = len(points)
    if total <= n or n < 3:
        return list(points)
    size = (total - 2) / (n - 2)
    edge = lambda b: int(b * size + 1)
    out, prev = [points[0]], points[0]
    for b in range(n - 2):
        nxt = points[edge(b + 1):min(edge(b + 2), total)] or [points[-1]]
        ax, ay = sum(p[0] for p in nxt) / len(nxt), sum(p[1] for p in nxt) / len(nxt)
        prev = max(points[edge(b):edge(b + 1)], key=lambda p: abs((prev[0] - ax) * (p[1] - prev[1]) - (prev[0] - p[0]) * (ay - prev[1])))
        out.append(prev)
    return out + [points[-1]]


def traces(rows):
    """Stack traces; rows: (line, tag, dict of extracted fields thread/app/exc/cause/frame)."""
    fatal = err = None
    out, table = [], {}
    framework = ("java.", "javax.", "android.", "com.android.", "libcore.", "sun.", "dalvik.", "kotlin.", "androidx.")

    def note():
        e, r = fatal["exc"], fatal["root"]
        table[fatal["app"]] = e + (f" (root: {r})" if r and r != e else "") + f" on {fatal['thread']}"

    def close(line):
        nonlocal fatal
        if fatal and fatal["app"]:
            note()
            out.append((line, fatal["app"], fatal["exc"], fatal["root"] or fatal["exc"], fatal["thread"], fatal["start"], True))
        fatal = None

    def close_err(line):
        nonlocal err
        if err:
            out.append((line, err["src"] or "System.err", err["exc"], err["root"], "", err["start"], False))
        err = None

    for line, tag, f in rows:
        if f.get("thread"):
            close(line)
            fatal = {"thread": f["thread"], "app": "", "exc": "", "root": "", "start": line}
            continue
        if fatal and f.get("app"):
            fatal["app"] = f["app"]
            continue
        if fatal and tag == "AndroidRuntime":
            fatal["root"] = f.get("cause") or fatal["root"]
            fatal["exc"] = fatal["exc"] or f.get("exc", "")
            if fatal["app"] and fatal["exc"]:
                note()
            continue
        if fatal:
            close(line)
        if tag != "System.err":
            close_err(line)
            if f.get("exc") and not f.get("cause") and not f.get("frame"):
                out.append((line, tag, f["exc"], f["exc"], "", line, False))
            continue
        if f.get("exc") and not f.get("cause"):
            close_err(line)
            err = {"src": "", "exc": f["exc"], "root": f["exc"], "start": line}
        elif err and f.get("cause"):
            err["root"] = f["cause"]
        elif err and f.get("frame") and not err["src"] and not f["frame"].startswith(framework):
            err["src"] = f["frame"]
    return out, table
