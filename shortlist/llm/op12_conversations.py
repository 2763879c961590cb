"""Repair of conversation structure by Wagner-Fischer alignment with the turns that a grammar allows.

A conversation's roles are to begin with an optional system turn and to alternate user, assistant from there: their initials match
``(s?(ua)+)?``.  Turns are kept (0), given the role that is due (3), deleted (4), or put in empty (3); blank and repeated turns must
be deleted, and a truncated turn that stays costs 3 more.  The cheapest edits are found, among equally cheap ones
those whose initials (D, I, K, R) are least as a string.

Alignment: for each way to end (with a user or an assistant turn) one table is filled from the last turn backwards; column j holds the
cheapest alignment with the last j turns of the alternating string, so that it serves every feasible length of the target.
The table is banded (Ukkonen): with t above the unavoidable cost, at most t / 3 turns are put in and only so many deleted as t
pays for.  t begins at the cost of a greedy repair (the incumbent) and grows until no alignment found costs more.  Each
target length with the least cost is traced back, and the audits are compared as strings.  Turns that must go are left out of the
tables and their D put back behind the turn before them: D comes before I, so that is where the least audit has them.

A stretch of turns is summed up by its cheapest edits from each state (nothing yet, after s, u, a) to each other one, where turns put in
belong to the turn that follows.  Whole conversations are one stretch up to ``LONG_ROWS`` turns and ``LONG_BYTES``.  Longer ones
are cut into stretches of ``BLOCK_ROWS`` turns by place; the stretches' costs are combined from the last to the first, then states
are handed on from the first to the last (two sorted streams of one small row a stretch), and the text is repaired stretch by
stretch.  No audit within a stretch is the beginning of another one, so the least whole audit is made of those that the states pick.

Scale: one shuffle of the turns by conversation, sorted in Spark and read as a stream; a task holds one conversation of bounded size at
a time.  A conversation of any length is spread over tasks (turns alike in all columns are counted first, repeats found by an
aggregate); only its SHA-256 is by nature one stream, of its repaired text, and its audit one string.

Nulls and odd input: a null role or text, and a null id or turn in the key of the damage, is one space; null turns come first; rows
of one turn are ordered by role, then text (after damage); a null conv_id is a conversation like any other; a role without characters has no
initial and must be changed or deleted; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import dense_index
from . import common as C

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Turns and bytes of text of a conversation that one task takes whole, turns of a stretch of a longer one.
LONG_ROWS = 2048
LONG_BYTES = 32_000_000
BLOCK_ROWS = 512
WHITE = " \t\n\u000b\f\r"

#: States: what the repaired turns so far end with.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What is put in at the end of a conversation in each state, as roles.
TAIL = {START: [], SYSTEM: ["user", "assistant"], USER: ["assistant"], ASSISTANT: []}
NAMES = {USER: "user", ASSISTANT: "assistant"}
STATE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = {"su", "ua", "au"}
#: Greater than any cost, and still far from overflow when costs are added.
FAR = 1 << 40


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times of every row: times is 0 for a dropped turn and 2 for a repeated one."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(hit <= 1, F.lit("")).when(hit == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    times = F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1)
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(hit == 4, F.lit("user")).otherwise(spaced("role")).alias("role"), text.alias("text"), times.alias("times"),
    )


def _faults(rows: DataFrame) -> DataFrame:
    """``rows`` with blank and cut (a text that doesn't end a sentence)."""
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    return rows.withColumn("blank", end == "").withColumn("cut", ~F.right(end, F.lit(1)).isin(".", "!", "?"))


def _greedy(kinds: np.ndarray) -> int:
    """The cost above the unavoidable one of a repair that puts in or changes a turn wherever one is due."""
    cost, due = 0, USER
    for i, kind in enumerate(kinds):
        if kind == SYSTEM and i == 0:
            continue
        if kind in (USER, ASSISTANT):
            if kind != due:
                cost += INSERT
            due = USER + ASSISTANT - kind
        else:
            cost += REROLE
            due = USER + ASSISTANT - due
    return cost + 2 * INSERT


class _Table:
    """Cheapest alignments of turns i.. with the last j turns of a target that ends with ``last``; offset j - (n - i) + down is stored."""

    def __init__(self, kinds: np.ndarray, cut: np.ndarray, last: int, up: int, down: int):
        n, width = len(kinds), up + down + 1
        self.kinds, self.cut, self.last, self.down = kinds, cut, last, down
        offset = np.arange(width)
        rise = INSERT * offset
        self.cells = np.full((n + 1, width), FAR, np.int64)
        self.cells[n, down] = 0
        for i in range(n - 1, -1, -1):
            j = offset - down + n - i
            char = np.where(j % 2 == 1, last, USER + ASSISTANT - last)
            row = self.cells[i + 1] + np.where(char == kinds[i], KEEP, REROLE) + TRUNCATED * int(cut[i])
            row[:-1] = np.minimum(row[:-1], self.cells[i + 1][1:] + DELETE)
            row[j < 0] = FAR
            row = np.minimum.accumulate(row - rise) + rise
            row[j < 0] = FAR
            self.cells[i] = np.minimum(row, FAR)

    def cost(self, i: int, j: int) -> int:
        c = j - (len(self.kinds) - i) + self.down
        return int(self.cells[i, c]) if 0 <= c < self.cells.shape[1] and j >= 0 else FAR

    def lengths(self, i: int, odd: int, least: int) -> tuple[int, list[int]]:
        """The cheapest cost of turns i.. over target lengths of one parity from ``least``, and the lengths that have it."""
        j = np.arange(self.cells.shape[1]) - self.down + len(self.kinds) - i
        some = np.where((j >= least) & (j % 2 == odd), self.cells[i], FAR)
        best = int(some.min(initial=FAR))
        return best, j[some == best].tolist() if best < FAR else []

    def trace(self, i: int, j: int) -> str:
        """The least audit of the cheapest alignment."""
        out, now = [], self.cost(i, j)
        while i < len(self.kinds):
            if self.cost(i + 1, j) + DELETE == now:
                out.append("D")
                i, now = i + 1, now - DELETE
            elif self.cost(i, j - 1) + INSERT == now:
                out.append("I")
                j, now = j - 1, now - INSERT
            else:
                char = self.last if j % 2 else USER + ASSISTANT - self.last
                out.append("K" if char == self.kinds[i] else "R")
                i, j = i + 1, j - 1
                now = self.cost(i, j)
        return "".join(out)


def stretch(codes: bytes, entries: tuple[int, ...] = (START, SYSTEM, USER, ASSISTANT)) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) -> (cost, audit) of turns that needn't go; a code is a state (0: another role), 8 more if truncated."""
    n = len(codes)
    if not n:
        return {(e, e): (0, "") for e in entries}
    raw = np.frombuffer(codes, np.uint8)
    kinds, cut = (raw & 7).astype(np.int64), raw >= 8
    sure = TRUNCATED * int(cut.sum())
    t = _greedy(kinds)
    while True:
        few = int(cut.sum())  # to delete a truncated turn costs one more than to keep it
        down = min(n, t // (DELETE - TRUNCATED) if t <= few * (DELETE - TRUNCATED) else few + (t - few) // DELETE)
        tables = {last: _Table(kinds, cut, last, t // INSERT + 1, down + 1) for last in (USER, ASSISTANT)}
        found: dict[tuple[int, int], tuple[int, list[tuple[int, int, int]]]] = {}
        for last, table in tables.items():
            for e in entries:
                due = ASSISTANT if e == USER else USER
                odd = int(due == last)
                cost, lengths = table.lengths(0, odd, 0 if e == last else 1)
                ways = [(-1, 0, j) for j in lengths]
                if e == START:  # a system turn is kept, what was before it goes
                    for i in np.flatnonzero(kinds == SYSTEM).tolist():
                        more, lengths = table.lengths(i + 1, odd, 1)
                        more += DELETE * i + TRUNCATED * int(cut[i])
                        if more < cost:
                            cost, ways = more, []
                        if more == cost and more < FAR:
                            ways += [(i, i + 1, j) for j in lengths]
                found[e, last] = cost, ways
        if max((cost for cost, _ in found.values()), default=0) - sure <= t:
            break
        t *= 2
    out = {}
    for (e, last), (cost, ways) in found.items():
        out[e, last] = cost, min(("D" * kept + "K" if kept >= 0 else "") + tables[last].trace(i, j) for kept, i, j in ways)
    for e in entries:
        if e in (START, SYSTEM):
            out[e, e] = DELETE * n, "D" * n
    if START in entries and (kinds == SYSTEM).any():
        cost, i = min((TRUNCATED * int(cut[i]), -i) for i in np.flatnonzero(kinds == SYSTEM).tolist())
        out[START, SYSTEM] = DELETE * (n - 1) + cost, "D" * -i + "K" + "D" * (n - 1 + i)
    return out


@lru_cache(maxsize=1 << 14)
def _short_whole(codes: bytes) -> tuple[int, str]:
    return _whole(codes)


def _whole(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation's turns that needn't go."""
    ways = stretch(codes, (START,))
    return min((cost + INSERT * len(TAIL[x]), audit + "I" * len(TAIL[x])) for (_, x), (cost, audit) in ways.items())


def woven(audit: str, gone: list[int]) -> str:
    """The audit with the turns that must go: gone[k] of them follow the k-th turn that needn't (gone[0]: precede the first)."""
    if not any(gone):
        return audit
    out, k = ["D" * gone[0]], 0
    for edit in audit:
        out.append(edit)
        if edit != "I":
            k += 1
            out.append("D" * gone[k])
    return "".join(out)


def repaired(audit: str, rows: list[tuple[str, str]], state: int) -> list[str]:
    """The lines (role:text) that ``audit`` makes of ``rows`` (role, text) from ``state`` on."""
    out, at = [], 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        due = ASSISTANT if state == USER else USER
        if edit == "I":
            out.append(f"{NAMES[due]}:")
        else:
            role, text = rows[at]
            at += 1
            if edit == "K":
                due = STATE_OF[role[:1]]
            out.append(f"{role if edit == 'K' else NAMES[due]}:{text}")
        state = due
    return out


def _code(role: str, cut: bool) -> int:
    return STATE_OF.get(role[:1], 0) + 8 * cut


def _n_illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def judge(rows: list[tuple]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of a conversation's ordered (turn, role, text, times, blank, cut)."""
    lines, codes, gone, seen = [], bytearray(), [0], set()
    n_blank = n_duplicate = 0
    for _, role, text, times, blank, cut in rows:
        for _ in range(times):
            lines.append((role, text))
            if blank:
                n_blank += 1
                gone[-1] += 1
            elif (role, text) in seen:
                n_duplicate += 1
                gone[-1] += 1
            else:
                seen.add((role, text))
                codes.append(_code(role, cut))
                gone.append(0)
    turns = {r[0] for r in rows if r[3] and r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit = _short_whole(bytes(codes)) if len(codes) <= 64 else _whole(bytes(codes))
    audit = woven(audit, gone)
    digest = hashlib.sha256("\n".join(repaired(audit, lines, START)).encode()).hexdigest()
    illegal = _n_illegal([role[:1] for role, _ in lines])
    return gaps, n_blank, n_duplicate, sum(c >= 8 for c in codes), illegal, cost + DELETE * sum(gone), audit, digest


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES_OUT = [c.split()[0] for c in RESULT.split(", ")]


def _rows_of(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple]:
    return zip(*[batch.column(c).to_pylist() for c in columns])


def _short(rows: DataFrame) -> DataFrame:
    """Results of conversations of bounded size: sorted by conversation in Spark, one held at a time."""
    columns = ["turn", "role", "text", "times", "blank", "cut"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def table(done: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in enumerate(kinds)], NAMES_OUT)

        for batch in batches:
            done = []
            for conv_id, group in groupby(_rows_of(batch, ["conv_id", *columns]), lambda r: r[0]):
                if held and conv_id != now:
                    done.append((now, *judge(held)))
                    held = []
                now = conv_id
                held += [r[1:] for r in group]
            yield table(done)
        if held:
            yield table([(now, *judge(held))])

    dealt = rows.select("conv_id", *columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(walk, RESULT)


def _stretches(rows: DataFrame) -> DataFrame:
    """key, block, costs, ranks and audits by (state before, state after), and the block's facts, of placed rows."""
    kind = "key string, block long, costs array<long>, ranks array<int>, audits array<string>, first string, last string, blank long, duplicate long, truncated long, illegal long"

    def sum_up(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        codes, gone, initials = bytearray(), [0], []
        n_blank = n_duplicate = n_equal = 0
        for role, n, blank, cut, new in zip(*[table.column(c).to_pylist() for c in ("role", "n", "blank", "cut", "new")]):
            initials.append(role[:1])
            n_equal += n - 1  # no initial may follow itself
            if blank:
                n_blank += n
                gone[-1] += n
                continue
            n_duplicate += n - new
            if new:
                codes.append(_code(role, cut))
                gone.append(0)
            gone[-1] += n - new
        ways = {pair: (cost + DELETE * sum(gone), woven(audit, gone)) for pair, (cost, audit) in stretch(bytes(codes)).items()}
        costs, ranks, audits = [None] * 16, [None] * 16, [None] * 16
        for rank, ((e, x), (cost, audit)) in enumerate(sorted(ways.items(), key=lambda w: w[1][1])):
            costs[4 * e + x], ranks[4 * e + x], audits[4 * e + x] = cost, rank, audit
        out = [[table.column("key")[0].as_py()], [table.column("block")[0].as_py()], [costs], [ranks], [audits], [initials[0]], [initials[-1]],
               [n_blank], [n_duplicate], [sum(c >= 8 for c in codes)], [_n_illegal(initials) + n_equal]]
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(), pa.string()] + [pa.int64()] * 4
        return pa.table([pa.array(v, k) for v, k in zip(out, kinds)], names=[c.split()[0] for c in kind.split(", ")])

    return rows.select("key", "block", "place", "role", "n", "blank", "cut", "new").groupBy("key", "block").applyInArrow(sum_up, kind)


def _sorted_stream(rows: DataFrame, descending: bool, step, kind: str) -> DataFrame:
    """``step`` (state or None for a new key, row) -> (state, output values) over each key's blocks in order, as one stream."""
    columns = rows.columns
    names = [c.split()[0] for c in kind.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["key"] != key:
                    key, state = row["key"], None
                state, values = step(state, row)
                out.append(dict(zip(names, (key, row["block"], *values))))
            yield from pa.Table.from_pylist(out, schema=schema).to_batches() if out else []

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in kind.split(", ")])
    order = F.desc("block") if descending else F.asc("block")
    return rows.select(*columns).repartition("key").sortWithinPartitions("key", order).mapInArrow(walk, kind)


def _choose(after: list[int] | None, row: dict) -> tuple[list[int], tuple]:
    """From the last stretch to the first: the state that each state leads to, and what the rest costs from there."""
    after = after or [INSERT * len(TAIL[x]) for x in range(4)]
    best = []
    for e in range(4):
        ways = [(row["costs"][4 * e + x] + after[x], row["ranks"][4 * e + x], x) for x in range(4) if row["costs"][4 * e + x] is not None]
        best.append(min(ways) if ways else (FAR, 0, e))
    return [b[0] for b in best], ([b[2] for b in best], best[START][0])


def _hand_on(state: tuple | None, row: dict) -> tuple[tuple, tuple]:
    """From the first stretch to the last: the states before and after it, and whether its first turn may not follow the last one."""
    before, last = state or (START, None)
    after = row["next"][before]
    return (after, row["last"]), (before, after, 0 if last is None else int(last + row["first"] not in LEGAL))


def _long(rows: DataFrame) -> DataFrame:
    """Results of conversations of any size, from their rows (key, turn, role, text, times, blank, cut) that aren't dropped."""
    same = C.settle(rows.groupBy("key", "turn", "role", "text", "blank", "cut").agg(F.sum("times").cast("long").alias("n")), "turns")
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = same.groupBy(F.col("key").alias("k"), F.col("role").alias("r"), F.md5("text").alias("m")).agg(F.min(when).alias("first"))
    met = same.join(first, (F.col("key") == F.col("k")) & (F.col("role") == F.col("r")) & (F.md5("text") == F.col("m")))
    met = met.withColumn("new", (when == F.col("first")).cast("int")).withColumn("order", F.struct("key", "turn", "role", "text"))
    placed = dense_index(met.drop("k", "r", "m", "first"), "order", "place").drop("order")
    begin = placed.groupBy(F.col("key").alias("k")).agg(F.min("place").alias("begin"))
    placed = placed.join(begin, F.col("key") == F.col("k")).withColumn("block", F.floor((F.col("place") - F.col("begin")) / BLOCK_ROWS).cast("long"))
    placed = C.settle(placed.drop("k", "begin"), "placed")
    blocks = C.settle(_stretches(placed), "stretches")
    chosen = C.settle(_sorted_stream(blocks.select("key", "block", "costs", "ranks"), True, _choose, "key string, block long, next array<int>, cost long"), "chosen")
    facts = blocks.select("key", "block", "first", "last").join(chosen, ["key", "block"])
    states = C.settle(_sorted_stream(facts, False, _hand_on, "key string, block long, before int, after int, joint long"), "states")
    audits = blocks.join(states, ["key", "block"]).withColumn("audit", F.element_at("audits", 4 * F.col("before") + F.col("after") + 1)).drop("audits", "costs", "ranks")
    audits = C.settle(audits, "audits")

    def mend(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        lines = [(role, text) for role, text, n in zip(*[table.column(c).to_pylist() for c in ("role", "text", "n")]) for _ in range(n)]
        out = repaired(table.column("audit")[0].as_py(), lines, table.column("before")[0].as_py())
        return pa.table([table.column("key")[:1], table.column("block")[:1], pa.array(["\n".join(out) if out else None], pa.string())], names=["key", "block", "piece"])

    asked = placed.select("key", "block", "place", "role", "text", "n").join(audits.select("key", "block", "before", "audit"), ["key", "block"])
    pieces = asked.groupBy("key", "block").applyInArrow(mend, "key string, block long, piece string")
    last = audits.groupBy("key").agg(F.max_by("after", "block").alias("end"), F.max("block").alias("block"))
    tail = F.lit(None).cast("string")
    for state, roles in TAIL.items():
        tail = F.when(F.col("end") == state, F.lit("\n".join(f"{r}:" for r in roles) or None)).otherwise(tail)
    pieces = C.settle(pieces.unionByName(last.select("key", (F.col("block") + 1).alias("block"), tail.alias("piece"))), "pieces")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, any_ = None, None, False
        for batch in batches:
            for k, piece in _rows_of(batch, ["key", "piece"]):
                if k != key:
                    if key is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], ["key", "repaired_sha256"])
                    key, sha, any_ = k, hashlib.sha256(), False
                if piece is not None:
                    sha.update(("\n" if any_ else "").encode() + piece.encode())
                    any_ = True
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], ["key", "repaired_sha256"])

    shas = pieces.repartition("key").sortWithinPartitions("key", "block").mapInArrow(digest, "key string, repaired_sha256 string")
    costs = chosen.filter("block = 0").select("key", "cost")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"])
    sums = audits.groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum(F.col("illegal") + F.col("joint")).alias("illegal"), F.array_join(parts, "").alias("audit")
    )
    ends = F.when(F.col("end") == SYSTEM, "II").when(F.col("end") == USER, "I").otherwise("")
    sums = sums.join(last.select("key", ends.alias("put_in")), "key").withColumn("audit", F.concat("audit", "put_in")).drop("put_in")
    turns = same.filter("turn IS NOT NULL").groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy("key")
    gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    return sums.join(costs, "key").join(shas, "key").join(gaps, "key", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)).cast("long"))


def _key() -> Column:
    """A conversation's id as a string that is never null."""
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("none"))


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row for every conv_id of ``rows`` (conv_id, turn, role, text, times): see the module's head; times is 0 for a turn that isn't there."""
    rows = rows.select("conv_id", "turn", "role", "text", "times")
    sizes = rows.groupBy("conv_id").agg(F.sum(F.greatest("times", F.lit(1))).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    large = C.settle(sizes.filter((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select("conv_id", _key().alias("key")), "long")
    if large.isEmpty():
        return _short(_faults(rows))
    ids = large.select(F.col("key").alias("k"))
    keyed = rows.withColumn("key", _key())
    short = _short(_faults(keyed.join(ids, F.col("key") == F.col("k"), "left_anti")))
    found = _long(_faults(keyed.join(ids, F.col("key") == F.col("k"), "left_semi").filter("times > 0")))
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    whole = large.join(found, "key", "left").select("conv_id", *[F.coalesce(c, F.lit(empty.get(c, 0))).alias(c) for c in NAMES_OUT[1:]])
    return short.unionByName(whole)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: The cheapest edits by the states of the grammar, turn by turn, instead of by targets.  CRC-32 goes by half bytes, the low half first.
OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(unnest(range(16)) AS BIGINT) AS i))
), named AS (
  SELECT row_number() OVER () AS r, conv_id, coalesce(CAST(conv_id AS VARCHAR), 'none') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS f FROM conversations
), hit AS (
  SELECT r, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
           list_transform(range(CAST(length(hex(f)) AS BIGINT)), lambda i: CAST(strpos('0123456789ABCDEF', substr(hex(f), i + 2 - 2 * (i % 2), 1)) - 1 AS BIGINT))),
           lambda c, h: xor(c >> 4, t[(xor(c, h) & 15) + 1])), 4294967295) % 20 AS h FROM named, crc
), damaged AS (
  SELECT k, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM named JOIN hit USING (r)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), judged AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, substr(role, 1, 1) AS c
  FROM placed
), facts AS (
  SELECT *, blank OR again AS gone, lag(c) OVER (PARTITION BY k ORDER BY i) AS c0 FROM judged
), steps AS (
  SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit FROM named
  UNION ALL
  SELECT k, i, state, cost, audit FROM (
    SELECT *, row_number() OVER (PARTITION BY k, state ORDER BY cost, audit) AS best FROM (
      SELECT k, i, CASE op WHEN 'D' THEN mid WHEN 'K' THEN CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE mid WHEN 2 THEN 3 ELSE 2 END END AS state,
             cost + 3 * m + CASE op WHEN 'D' THEN 4 WHEN 'K' THEN 0 ELSE 3 END + CASE WHEN op <> 'D' AND cut THEN 3 ELSE 0 END AS cost,
             audit || repeat('I', m) || op AS audit
      FROM (
        SELECT f.k, f.i, f.c, f.gone, f.cut, s.cost, s.audit, m, op,
               CASE WHEN m = 0 THEN s.state WHEN (m = 1) = (s.state = 2) THEN 3 ELSE 2 END AS mid
        FROM steps s JOIN facts f ON f.k = s.k AND f.i = s.i + 1, (SELECT unnest([0, 1, 2]) AS m), (SELECT unnest(['D', 'K', 'R']) AS op)
      )
      WHERE op = 'D' OR (NOT gone AND (op = 'R' OR (c = 's' AND mid = 0) OR (c = 'u' AND mid <> 2) OR (c = 'a' AND mid = 2)))
    )
  ) WHERE best = 1
), sizes AS (SELECT k, count(*) AS n FROM facts GROUP BY k),
ends AS (
  SELECT k, min(struct_pack(cost := cost + CASE state WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, audit := audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END)) AS e
  FROM steps LEFT JOIN sizes USING (k) WHERE i = coalesce(n, 0) GROUP BY k
), edits AS (
  SELECT k, p, op, sum(CASE WHEN op = 'I' THEN 0 ELSE 1 END) OVER w AS i, sum(CASE WHEN op = 'D' THEN 0 ELSE 1 END) OVER w AS q
  FROM (SELECT k, p, substr(e.audit, p, 1) AS op FROM (SELECT k, e, unnest(range(1, CAST(length(e.audit) + 1 AS BIGINT))) AS p FROM ends))
  WINDOW w AS (PARTITION BY k ORDER BY p)
), given AS (
  SELECT x.k, p, op, q, f.role, f.text, f.c, bool_or(op = 'K' AND f.c = 's') OVER (PARTITION BY x.k) AS has_system
  FROM edits x LEFT JOIN facts f ON f.k = x.k AND f.i = x.i AND op <> 'I' WHERE op <> 'D'
), texts AS (
  SELECT k, string_agg(CASE WHEN op = 'K' THEN role ELSE CASE WHEN (q % 2 = 1) <> has_system THEN 'user' ELSE 'assistant' END END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS t
  FROM given GROUP BY k
), sums AS (
  SELECT k, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, sum(CASE WHEN blank THEN 1 ELSE 0 END) AS blank,
         sum(CASE WHEN again AND NOT blank THEN 1 ELSE 0 END) AS duplicate, sum(CASE WHEN cut AND NOT gone THEN 1 ELSE 0 END) AS truncated,
         sum(CASE WHEN i > 1 AND c0 || c NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS illegal
  FROM facts GROUP BY k
)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(e.cost AS BIGINT) AS cost, e.audit AS audit,
       sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM named) JOIN ends USING (k) LEFT JOIN sums USING (k) LEFT JOIN texts USING (k)
"""
