"""Conversation structure repair: cheapest edits to alternating turns, ties to the least audit text.

Rows of a conversation, in order, are kept, given another role, deleted, or followed by inserted turns, until the roles read
``(s?(ua)+)?``.  A *node* is a place between two rows and what was last put out (nothing, system, user, assistant); an edit is an *arc*.

*Cost DP.* A row is a 4 x 4 matrix of least costs between states, and rows compose by the (min, +) product, so costs to the end come from
suffix products by doubling, without a loop over rows.

*Path ranking.* The arcs that lie on cheapest paths are ranked by their audit letter, then by the audit of length 2, 4, 8 ... that begins with
them: the rank of twice the length is the pair of an arc's rank and the rank of the arc its pointer leads to, and pointers are doubled
alike. A node's cheapest arcs carry different letters, so ranks tell them apart and every arc has one least continuation. The least path of
a conversation begins with the least-ranked arc of its first node, and its ``t``-th arc is found by the pointers of the bits of ``t``.

*Any length.* Rows are range partitioned by conversation and turn, which also splits a conversation that holds a third of all rows.
Conversations that begin and end inside a partition are solved there, many at once. The others are cut into blocks of at most ``BLOCK`` rows:
a block is summed up as a matrix, matrices are chained into the cost after each block, each block then tells where its least path
leads from each of the four states, and chaining these gives its real start; every block then writes its own part of the audit. The digest of
the repaired text is a function of the whole text in order, so the lines of such a conversation pass one task as a sorted stream,
which never holds more than a batch of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import keep

BLOCK = 4096
#: Rows of whole conversations that are solved together.
TOGETHER = 8192
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = ["", "system", "user", "assistant"]
LETTERS = "DIKR"  # in ASCII order
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
FAR = 1 << 40
_SPACE = " \t\n\x0b\x0c\r"
_DUE = np.array([USER, USER, ASSISTANT, USER])
#: Cost from each state to an allowed end, and the inserts that lead there.
_END = np.array([0, 4, 2, 0])
_END_ROLES = [[], [USER, ASSISTANT], [ASSISTANT], []]
_GONE = -1


def row_code(role: str, text: str) -> int:
    """Kind of the initial (0 to 3: s, u, a, other), 4 if the text does not end a sentence, 8 if it is blank."""
    shown = text.rstrip(_SPACE)
    return ("sua".find(role[:1]) if role else -1) % 4 + (0 if shown[-1:] in (".", "!", "?") and shown else 4) + (0 if shown else 8)


def _min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), FAR)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code: the state a kept row leads to from each state (-1: it cannot be kept), and its cost matrix with inserts before it."""
    keep_to, cost = np.full((16, 4), -1), np.full((16, 4, 4), FAR)
    insert = np.full((4, 4), FAR)
    for q in range(4):
        once = _DUE[q]
        insert[q, _DUE[once]] = 2 * INSERT
        insert[q, once] = min(insert[q, once], INSERT)
        insert[q, q] = 0
    for code in range(16):
        kind, cut, must = code & 3, code >> 2 & 1, code >> 3
        for q in range(4):
            cost[code, q, q] = DELETE
            if not must:
                if kind == 0 and q == START:
                    keep_to[code, q] = SYSTEM
                elif kind < 3 and kind + 1 == _DUE[q]:
                    keep_to[code, q] = kind + 1
                cost[code, q, _DUE[q]] = min(cost[code, q, _DUE[q]], REROLE + CUT * cut)
                if keep_to[code, q] >= 0:
                    cost[code, q, keep_to[code, q]] = CUT * cut
    return keep_to, _min_plus(insert[None], cost)


KEEP_TO, COST = _tables()


def suffix_products(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each row the product of the matrices from it up to the end of its segment."""
    out, reach, at = COST[codes], 1, np.arange(len(codes))
    longest = int((ends - at).max(initial=0))
    while reach < longest:
        more = np.flatnonzero(at + reach < ends)
        out[more] = _min_plus(out[more], out[more + reach])
        reach *= 2
    return out


class LeastPaths:
    """Ranked cheapest arcs of segments of rows, given the costs after each segment's end.

    Node ``4 * layer + state``; segment ``s`` with rows ``a`` to ``b`` has the layers ``a + s`` to ``b + s``.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, after: np.ndarray):
        n, segments = len(codes), len(sizes)
        seg = np.repeat(np.arange(segments), sizes)
        stop = np.cumsum(sizes)
        self.end = stop + np.arange(segments)
        self.first = self.end - sizes
        layer = np.arange(n) + seg
        cost = np.empty((n + segments, 4), np.int64)
        cost[self.end] = after
        if n:
            cost[layer] = (suffix_products(codes, stop[seg]) + after[seg][:, None, :]).min(2)
        self.cost = cost
        here, then, cut = cost[layer], cost[layer + 1], (codes >> 2 & 1)[:, None]
        to = KEEP_TO[codes]
        best, target = np.empty((n, 4, 4), bool), np.empty((n, 4, 4), np.int64)
        at, next_ = 4 * layer[:, None], 4 * (layer[:, None] + 1)
        best[:, :, 0], target[:, :, 0] = here == DELETE + then, next_ + np.arange(4)
        best[:, :, 1], target[:, :, 1] = here == INSERT + here[:, _DUE], at + _DUE
        best[:, :, 2], target[:, :, 2] = (to >= 0) & (here == CUT * cut + np.take_along_axis(then, np.maximum(to, 0), 1)), next_ + to
        best[:, :, 3], target[:, :, 3] = (codes < 8)[:, None] & (here == REROLE + CUT * cut + then[:, _DUE]), next_ + _DUE
        arcs = np.flatnonzero(best)
        m = len(arcs)
        self.letter, self.row, self.to = arcs % 4, arcs // 16, target.ravel()[arcs]
        node = 4 * layer[self.row] + arcs // 4 % 4
        self.arcs_from = np.searchsorted(node, np.arange(4 * (n + segments) + 1))  # arcs are in the order of their nodes
        rank = np.append(self.letter + 1, 0)  # the end ranks lowest
        pointer = np.append(self._least(self.to, rank), m)
        self.length = np.append(np.ones(m, np.int64), 0)
        self.pointers = []
        while True:
            self.pointers.append(pointer)
            if (pointer == m).all():
                break
            self.length = self.length + self.length[pointer]
            rank = np.unique(rank * (int(rank.max()) + 1) + rank[pointer], return_inverse=True)[1]
            pointer = pointer[pointer]
        self.rank = rank

    def _least(self, nodes: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The arc of least rank from each node; the number of arcs stands for none."""
        lo, hi, out = self.arcs_from[nodes], self.arcs_from[nodes + 1], np.full(len(nodes), len(rank) - 1)
        for k in range(4):
            arc = np.minimum(lo + k, len(rank) - 1)
            better = (lo + k < hi) & ((out == len(rank) - 1) | (rank[arc] < rank[out]))
            out = np.where(better, arc, out)
        return out

    def read(self, segments: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs of the least path from each state at the start of each segment: all arcs, how many each path has, and its end state."""
        nodes = 4 * self.first[segments] + states
        begin = self._least(nodes, self.rank)
        sizes = self.length[begin]
        arcs = np.repeat(begin, sizes)
        step = np.arange(len(arcs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for k, pointer in enumerate(self.pointers):
            on = (step >> k & 1).astype(bool)
            arcs[on] = pointer[arcs[on]]
        last = np.cumsum(sizes) - 1
        ended = np.where(sizes > 0, (self.to[arcs[last]] if len(arcs) else nodes) % 4, states)
        return arcs, sizes, ended


def _written(arcs: np.ndarray, paths: LeastPaths, rows: list[tuple[str, str]]) -> tuple[str, list[str]]:
    """Audit letters and repaired lines of one path."""
    letters, at, to = paths.letter[arcs].tolist(), paths.row[arcs].tolist(), (paths.to[arcs] % 4).tolist()
    lines = []
    for x, i, q in zip(letters, at, to):
        if x == 1:
            lines.append(f"{ROLE[q]}:")
        elif x == 2:
            lines.append(f"{rows[i][0]}:{rows[i][1]}")
        elif x == 3:
            lines.append(f"{ROLE[q]}:{rows[i][1]}")
    return "".join(LETTERS[x] for x in letters), lines


class _Faults:
    """Counts over rows in order, which can be joined with those of the rows after them."""

    FIELDS = ["blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "turn_first", "turn_last", "initial_first", "initial_last"]

    def __init__(self, rows=(), codes=()):
        """``rows``: (role, text, turn); ``codes``: as ``row_code``, 16 added for duplicates."""
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.turn_first = self.turn_last = self.initial_first = self.initial_last = None
        for (role, _, turn), code in zip(rows, codes):
            self.blank += code & 24 == 8
            self.duplicate += code >> 4
            self.truncated += code < 8 and code & 4 > 0
            self._follow(role[:1], role[:1])
            if turn is not None:
                self._turn(turn, turn, turn, turn, 1)

    def _follow(self, first: str, last: str) -> None:
        if self.initial_last is None:
            self.initial_first = first
        elif self.initial_last + first not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial_last = last

    def _turn(self, first: int, last: int, low: int, high: int, n: int) -> None:
        """Turns come in order, so one that was there already is the last one."""
        self.turns += n - (self.turn_last == first)
        if self.turn_first is None:
            self.turn_first, self.low, self.high = first, low, high
        self.turn_last, self.low, self.high = last, min(self.low, low), max(self.high, high)

    def then(self, b: dict) -> None:
        for k in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, k, getattr(self, k) + b[k])
        if b["initial_first"] is not None:
            self._follow(b["initial_first"], b["initial_last"])
        if b["turn_first"] is not None:
            self._turn(b["turn_first"], b["turn_last"], b["low"], b["high"], b["turns"])

    def gaps(self) -> int:
        return 0 if self.turn_first is None else self.high - self.low + 1 - self.turns

    def values(self) -> list:
        return [getattr(self, k) for k in self.FIELDS]


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string, n_repaired bigint"
_RESULT = [x.split()[0] for x in RESULT.split(", ")]
_HELD = f"conv_id bigint, done boolean, {RESULT}, part int, seq bigint, turn bigint, role string, text string, code int, line binary"


def _solved(conversations: list[tuple], keep_lines: bool) -> Iterator[tuple]:
    """Results of whole conversations ``(conv_id, rows)`` with rows ``(role, text, turn)`` of those that are there."""
    codes, sizes = [], []
    for _, rows in conversations:
        seen = set()
        for role, text, _ in rows:
            code = row_code(role, text)
            if code < 8:
                code |= 24 * ((role, text) in seen)
            seen.add((role, text))
            codes.append(code)
        sizes.append(len(rows))
    sizes = np.array(sizes)
    paths = LeastPaths(np.array(codes, np.int64) & 15, sizes, np.tile(_END, (len(sizes), 1)))
    which = np.arange(len(sizes))
    arcs, lengths, ended = paths.read(which, np.zeros(len(sizes), np.int64))
    stops, row_stop, at = np.cumsum(lengths), np.cumsum(sizes), 0
    for s, (conv, rows) in enumerate(conversations):
        here = arcs[stops[s] - lengths[s]:stops[s]]
        own = codes[row_stop[s] - sizes[s]:row_stop[s]]
        letters, lines = _written(here, paths, _Shifted(rows, row_stop[s] - sizes[s]))
        audit = letters + "I" * len(_END_ROLES[ended[s]])
        lines += [f"{ROLE[q]}:" for q in _END_ROLES[ended[s]]]
        f = _Faults(rows, own)
        text = "\n".join(lines).encode()
        yield (conv, f.gaps(), f.blank, f.duplicate, f.truncated, f.illegal, int(paths.cost[paths.first[s], START]), audit, hashlib.sha256(text).hexdigest(), len(lines),
               text if keep_lines else None)


class _Shifted:
    """Rows by their number among the rows of several conversations."""

    def __init__(self, rows, base):
        self.rows, self.base = rows, int(base)

    def __getitem__(self, i):
        return self.rows[i - self.base]


def _within_partition(keep_lines: bool, block: int):
    """Solves the conversations that lie whole inside a sorted partition; the rows of the others are passed on, numbered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first = TaskContext.get().partitionId(), 0, True
        now, rows, passing = None, [], True
        whole, waiting = [], 0
        names = [x.split()[0] for x in _HELD.split(", ")]
        kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in _HELD.split(", ")]

        def table(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        def results() -> pa.RecordBatch:
            return table([(r[0], True, *r[1:10], part, None, None, None, None, None, r[10]) for r in _solved([(c, [x[:3] for x in rs if not x[3]]) for c, rs in whole], keep_lines)])

        def passed(conv, some: list[tuple]) -> list[pa.RecordBatch]:
            nonlocal seq
            out = []
            for lo in range(0, len(some), block):
                piece = some[lo:lo + block]
                out.append(table([(conv, False, *[None] * len(_RESULT), part, seq + i, turn, role, text, _GONE if gone else row_code(role, text), None)
                                  for i, (role, text, turn, gone) in enumerate(piece)]))
                seq += len(piece)
            return out

        for b in batches:
            for conv, turn, role, text, gone in zip(*(b.column(i).to_pylist() for i in range(5))):
                if first or conv != now:
                    if not first:
                        if passing:
                            yield from passed(now, rows)
                        else:
                            whole.append((now, rows))
                            waiting += len(rows)
                            if waiting >= TOGETHER:
                                yield results()
                                whole, waiting = [], 0
                    passing, first, now, rows = first, False, conv, []
                rows.append((role, text, turn, gone))
                if len(rows) >= block:  # too long to wait for its end here
                    passing = True
                    yield from passed(conv, rows)
                    rows = []
        if whole:
            yield results()
        if not first:
            yield from passed(now, rows)  # it may go on in the next partition
    return run


def _faulty(codes: np.ndarray, digests: list, later: set) -> np.ndarray:
    """Codes with 24 added for rows that repeat an earlier one: inside the block, or (``later``, places in the block) in an earlier block."""
    seen, out = set(), codes.copy()
    for i, d in enumerate(digests):
        if codes[i] < 8 and (d in seen or i in later):
            out[i] |= 24
        seen.add(d)
    return out


def _long_conversations(held: DataFrame, keep_lines: bool, size: int) -> DataFrame:
    """Results of conversations whose rows were passed on (``part``, ``seq`` in order)."""
    block = F.col("part").cast("bigint") * F.lit(1 << 32) + F.expr(f"seq div {size}L")
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    rows = held.filter("not done").select(key.alias("_key"), block.alias("_b"), "conv_id", "seq", "turn", "role", "text", "code")
    there = rows.filter(F.col("code") != _GONE)
    text = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    narrow = keep(there.select("_key", "_b", "seq", "code", F.unhex(F.sha2(text, 256)).alias("digest")))
    # A block gives each text once, so a text that fills the conversation has no more rows here than there are blocks.
    first = narrow.groupBy("_key", "_b", "digest").agg(F.min("seq").alias("seq"))
    before = F.lag("_b").over(W.partitionBy("_key", "digest").orderBy("_b"))
    later = first.withColumn("_before", before).filter("_before is not null").select("_key", "_b", "seq")

    def summed(key, t, again):
        t = t.sort_by("seq")
        place = {s: i for i, s in enumerate(t.column("seq").to_pylist())}
        codes = _faulty(t.column("code").to_numpy(), t.column("digest").to_pylist(), {place[s] for s in again.column("seq").to_pylist()})
        matrix = suffix_products(codes & 15, np.full(len(codes), len(codes)))[0]
        return pa.table({"_key": pa.array([key[0].as_py()], pa.string()), "_b": pa.array([key[1].as_py()], pa.int64()), "codes": pa.array([codes.astype(np.uint8).tobytes()], pa.binary()),
                         "matrix": pa.array([matrix.ravel().tolist()], pa.list_(pa.int64()))})
    blocks = keep(narrow.groupBy("_key", "_b").cogroup(later.groupBy("_key", "_b")).applyInArrow(summed, "_key string, _b bigint, codes binary, matrix array<bigint>"))

    def costs(key, t):  # a row for each block
        t = t.sort_by("_b")
        after, out = _END, []
        for m in reversed(t.column("matrix").to_pylist()):
            out.append(after.tolist())
            after = (np.array(m).reshape(4, 4) + after).min(1)
        return pa.table({"_key": t.column("_key"), "_b": t.column("_b"), "after": pa.array(out[::-1], pa.list_(pa.int64()))})
    after = blocks.select("_key", "_b", "matrix").groupBy("_key").applyInArrow(costs, "_key string, _b bigint, after array<bigint>")
    priced = keep(blocks.select("_key", "_b", "codes").join(after, ["_key", "_b"]))

    def leads(batches):
        for b in batches:
            out = []
            for codes, cost in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                paths = LeastPaths(np.frombuffer(codes, np.uint8).astype(np.int64) & 15, np.array([len(codes)]), np.array([cost]))
                out.append(paths.read(np.zeros(4, np.int64), np.arange(4))[2].tolist())
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], ["_key", "_b", "leads"])
    ways = priced.mapInArrow(leads, "_key string, _b bigint, leads array<bigint>")

    def states(key, t):  # a row for each block
        t = t.sort_by("_b")
        q, out = START, []
        for to in t.column("leads").to_pylist():
            out.append(q)
            q = to[q]
        return pa.table({"_key": t.column("_key"), "_b": t.column("_b"), "state": pa.array(out, pa.int64())})
    entered = keep(priced.join(ways.groupBy("_key").applyInArrow(states, "_key string, _b bigint, state bigint"), ["_key", "_b"]))

    piece = "_key string, _b bigint, at bigint, conv_id bigint, audit string, ended int, cost bigint, " + ", ".join(
        f"{f} {'string' if f.startswith('initial') else 'bigint'}" for f in _Faults.FIELDS) + ", line string"
    names = [x.split()[0] for x in piece.split(", ")]
    types = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[x.split()[1]] for x in piece.split(", ")]

    def written(key, t, how):
        t = t.sort_by("seq")
        conv, block = t.column("conv_id")[0].as_py() if t.num_rows else None, key[1].as_py()
        here = [(r, x, turn) for r, x, turn, code in zip(*(t.column(c).to_pylist() for c in ("role", "text", "turn", "code"))) if code != _GONE]
        if how.num_rows:
            codes = np.frombuffer(how.column("codes")[0].as_py(), np.uint8).astype(np.int64)
            paths = LeastPaths(codes & 15, np.array([len(codes)]), np.array([how.column("after")[0].as_py()]))
            state = how.column("state")[0].as_py()
            arcs, _, ended = paths.read(np.zeros(1, np.int64), np.array([state]))
            audit, lines = _written(arcs, paths, here)
            cost, ended = int(paths.cost[0, state] - paths.cost[paths.end[0], ended[0]]), int(ended[0])
        else:  # all its rows are gone
            codes, audit, lines, cost, ended = np.empty(0, np.int64), "", [], 0, None
        none = [None] * len(_Faults.FIELDS)
        out = [(key[0].as_py(), block, -1, conv, audit, ended, cost, *_Faults(here, codes.tolist()).values(), None)]
        out += [(key[0].as_py(), block, i, conv, None, None, None, *none, line) for i, line in enumerate(lines)]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), types)], names)
    pieces = rows.groupBy("_key", "_b").cogroup(entered.select("_key", "_b", "codes", "after", "state").groupBy("_key", "_b")).applyInArrow(written, piece)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = names.index("line"), None

        def result() -> pa.RecordBatch:
            ended = _END_ROLES[state]
            audit.append("I" * len(ended))
            for q in ended:
                put(f"{ROLE[q]}:")
            row = (conv, faults.gaps(), faults.blank, faults.duplicate, faults.truncated, faults.illegal, cost + INSERT * len(ended), "".join(audit), digest.hexdigest(), lines,
                   b"\n".join(kept) if keep_lines else None)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int64(), *[pa.int64()] * 6, pa.string(), pa.string(), pa.int64(), pa.binary()])], ["conv_id", *_RESULT, "line"])

        def put(line: str) -> None:
            nonlocal lines
            data = line.encode()
            digest.update(b"\n" + data if lines else data)
            lines += 1
            if keep_lines:
                kept.append(data)

        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                if r[0] != now:
                    if now is not None:
                        yield result()
                    now, conv, state, cost, lines, audit, kept, digest, faults = r[0], r[3], START, 0, 0, [], [], hashlib.sha256(), _Faults()
                if r[2] >= 0:
                    put(r[at])
                    continue
                audit.append(r[4])
                state, cost = state if r[5] is None else r[5], cost + r[6]
                faults.then(dict(zip(_Faults.FIELDS, r[7:at])))
        if now is not None:
            yield result()
    return pieces.repartition("_key").sortWithinPartitions("_key", "_b", "at").mapInArrow(joined, f"conv_id bigint, {RESULT}, line binary")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text, gone`` after damage by the hash of conversation and turn; dropped rows stay as ``gone``.

    A null is written as one blank in the hash, and a null role or text is one blank.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chance = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), said("role").alias("role"), said("text").alias("text"), chance.alias("_c"))
    text = F.when(F.col("_c") == 1, F.lit("")).when(F.col("_c") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_c") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("_c") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_c") == 0).alias("gone"), F.explode(times).alias("_time")).drop("_time")


def repair(rows: DataFrame, keep_lines: bool = False, block: int = BLOCK) -> DataFrame:
    """One row for each ``conv_id`` of ``rows`` (``conv_id, turn, role, text``, and ``gone`` for rows that only name their conversation): faults, cost and audit.

    Rows go by turn, nulls first; rows of one turn by role, then by the first 64 characters of the text, then by its hash. Null roles and texts count as one blank; a null ``conv_id`` is a conversation of its own;
    without rows all is zero or empty; an empty table gives an empty table. Only these columns are read. ``keep_lines`` adds the repaired lines
    (``role:text``, joined by newlines) as ``repaired``.
    """
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    # The row number comes last: equal rows of any number are dealt over partitions, and which of them comes first does not matter.
    # Range limits are made of sampled keys, so a key holds no whole text.
    order = ["conv_id", "turn", "role", "_head", "_hash", "_at"]
    named = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), said("role").alias("role"), said("text").alias("text"), gone.alias("gone"),
                        F.substring(said("text"), 1, 64).alias("_head"), F.md5(said("text")).alias("_hash"), F.monotonically_increasing_id().alias("_at"))
    placed = named.repartitionByRange(*order).sortWithinPartitions(*order)
    held = keep(placed.select("conv_id", "turn", "role", "text", "gone").mapInArrow(_within_partition(keep_lines, block), _HELD))
    done = held.filter("done").select("conv_id", *_RESULT, "line")
    both = done.unionByName(_long_conversations(held, keep_lines, block))
    return both.select("conv_id", *_RESULT, *([F.col("line").cast("string").alias("repaired")] if keep_lines else []))
