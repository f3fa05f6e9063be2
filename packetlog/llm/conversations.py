"""Conversation structure repair by bidirectional Dijkstra (operator 13).

A conversation's rows, in turn order, are edited at least cost so that the first
letters of its roles read ``(s?(ua)+)?``: an optional system row, then pairs of
user and assistant. Keep costs 0, Rerole (to user or assistant) 2, Delete 3 and
Insert (an empty user or assistant row, anywhere) 2; a row cut off in mid-sentence
that is not deleted adds 1; blank rows and repetitions must be deleted. Of equally
cheap edits the one whose string of initials (the audit) comes first in ASCII wins.

The edit lattice has a node for every (rows used, state of the role pattern). A
forward heap starts at the first node and a reverse heap at the accepting ones;
the cheaper front advances until the two minima together exceed the best crossing,
so that every equal-cost crossing is finished; the least concatenation of a
forward and a reverse audit is taken. The next role always follows from the state,
so an audit names one path only, no audit of a node is the prefix of another, and
least parts make the least whole.

At scale:

1. Rows without their texts are sorted by conversation and turn into ranges, so a
   conversation of any length is spread over many tasks, and cut into blocks of at
   most ``2^BLOCK_BITS`` rows. Repetitions are found by the least row of each
   (conversation, role, text).
2. A conversation of one block is searched at once. In a longer one each block is
   searched between all pairs of states; blocks hold no insertion behind their
   last row (but the last block), so each audit is cut in one way. Blocks are
   combined ``FAN`` at a time, level by level: cheapest sums, ties by the ranks of
   the blocks' audits. The chosen states then go down the levels again.
3. The texts are dealt by conversation and stream, in order, past the audits. A
   repaired conversation is one sequence with one checksum, so it passes through
   one task, row by row; that task holds its audit and no rows.

Edge cases: a null role or text counts as one blank, a null conv_id is a
conversation of its own, null turns come first. Rows of one turn are ordered by
role, the first ``HEAD`` characters of the text and a hash of the text; rows
equal in all of these are alike (the later ones are repetitions). An empty role
has no letter that fits, so its row is never kept as it is. (role, text)
pairs are compared by two 64-bit hashes. A conversation without rows needs no
edits. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlog.llm import common as C

BLOCK_BITS = 9
#: Blocks combined at once, as a power of two.
FAN_BITS = 8
HEAD = 64
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
BLANKS = " \t\n\x0b\f\r"
#: States of the role pattern: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the next user or assistant row, and the states before one.
AHEAD = (USER, USER, ASSISTANT, USER)
BEHIND = ((), (), (START, SYSTEM, ASSISTANT), (USER,))
ROLE = {USER: "user", ASSISTANT: "assistant"}
ORDER = ["conv_id", "turn", "role", "head", "h"]
FACTS = ("rows", "min_turn", "max_turn", "turns", "blank", "duplicate", "truncated", "illegal", "first", "last")


# ---------------------------------------------------------------- the search

def kept(state: int, initial: str) -> int | None:
    """The state after keeping a row, None where the pattern forbids it."""
    if initial == "s":
        return SYSTEM if state == START else None
    after = {"u": USER, "a": ASSISTANT}.get(initial)
    return after if after == AHEAD[state] else None


def _forward(rows, tail, i, q):
    """(cost, letter, i, q) of the edges that leave a node."""
    if i < len(rows):
        initial, fault = rows[i]
        yield DELETE, "D", i + 1, q
        if fault not in "BD":
            more = CUT if fault == "T" else 0
            to = kept(q, initial)
            if to is not None:
                yield KEEP + more, "K", i + 1, to
            yield REROLE + more, "R", i + 1, AHEAD[q]
    if i < len(rows) or tail:
        yield INSERT, "I", i, AHEAD[q]


def _reverse(rows, tail, i, q):
    """(cost, letter, i, q) of the edges that enter a node, by their start."""
    if i > 0:
        initial, fault = rows[i - 1]
        yield DELETE, "D", i - 1, q
        if fault not in "BD":
            more = CUT if fault == "T" else 0
            for p in range(4):
                if kept(p, initial) == q:
                    yield KEEP + more, "K", i - 1, p
            for p in BEHIND[q]:
                yield REROLE + more, "R", i - 1, p
    if i < len(rows) or tail:
        for p in BEHIND[q]:
            yield INSERT, "I", i, p


def shortest(rows: list[tuple[str, str]], start: int, ends: tuple[int, ...], tail: bool) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits that lead from state ``start``
    before the ``rows`` (initial, fault) to one of the states ``ends`` behind
    them; ``tail`` allows insertions behind the last row."""
    last = len(rows)
    # Heaps are ordered by cost, then in the direction of the search: an edge of
    # cost 0 uses a row, so whatever can better a node's audit is popped before it.
    found = [{(0, start): (0, "")}, {(last, e): (0, "") for e in ends}]
    heaps = [[(0, 0, start)], [(0, -last, e) for e in sorted(ends)]]
    exact = [set(found[0]), set(found[1])]
    done: list[set] = [set(), set()]
    edges, best = (_forward, _reverse), None
    meeting = found[0].keys() & found[1].keys()
    if meeting:
        best = 0
    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            break
        k = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, place, q = heapq.heappop(heaps[k])
        node = (abs(place), q)
        if node in done[k]:
            continue
        done[k].add(node)
        exact[k].add(node)
        audit, own, other = found[k][node][1], found[k], found[1 - k]
        for weight, letter, i, p in edges[k](rows, tail, *node):
            new = (cost + weight, letter + audit if k else audit + letter)
            known = own.get((i, p))
            if known is None or new < known:
                own[i, p] = new
                if known is None or new[0] < known[0]:
                    heapq.heappush(heaps[k], (new[0], -i if k else i, p))
            if (i, p) in other:
                whole = new[0] + other[i, p][0]
                best = whole if best is None else min(best, whole)
    if best is None:
        return None
    audits = []
    for node in exact[0]:
        cost, audit = found[0][node]
        if node in exact[1] and cost + found[1][node][0] == best:
            audits.append(audit + found[1][node][1])
        for weight, letter, i, p in _forward(rows, tail, *node):
            if (i, p) in exact[1] and cost + weight + found[1][i, p][0] == best:
                audits.append(audit + letter + found[1][i, p][1])
    return best, min(audits)


# ------------------------------------------------------------ blocks of rows

def _facts(rows: list[dict]) -> list:
    """What a block of rows (in order, not dropped) adds to the report."""
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    initials = [r["code"][0] for r in rows]
    faults = [r["code"][1] for r in rows]
    return [len(rows), turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)),
            faults.count("B"), faults.count("D"), faults.count("T"), sum(map(_illegal, initials, initials[1:])),
            ord(initials[0]) if rows else None, ord(initials[-1]) if rows else None]


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _joined(a: list, b: list) -> list:
    """Facts of two adjacent blocks."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    edge = int(_illegal(chr(a[9]), chr(b[8])))
    same = int(a[2] is not None and a[2] == b[1])
    return [a[0] + b[0], b[1] if a[1] is None else a[1], a[2] if b[2] is None else b[2], a[3] + b[3] - same,
            a[4] + b[4], a[5] + b[5], a[6] + b[6], a[7] + b[7] + edge, a[8], b[9]]


def _ranked(keys: list) -> list:
    """Ranks of a 4 x 4 table of comparable keys within each row of it."""
    ranks: list = [None] * 16
    for s in range(4):
        own = sorted((keys[4 * s + e], e) for e in range(4) if keys[4 * s + e] is not None)
        for rank, (_, e) in enumerate(own):
            ranks[4 * s + e] = rank
    return ranks


def solve_block(rows: list[dict], first: bool, last: bool) -> tuple[list, list, list]:
    """Costs, audits and audit ranks between the states before and behind a block:
    4 x 4 entries, None where there is no path. Behind the last block there is
    one state only, entry 0: accepted."""
    steps = [(r["code"][0], r["code"][1]) for r in rows]
    costs, audits = [None] * 16, [None] * 16
    for s in (START,) if first else range(4):
        for e in (START,) if last else range(4):
            found = shortest(steps, s, (START, ASSISTANT) if last else (e,), last)
            if found:
                costs[4 * s + e], audits[4 * s + e] = found
    return costs, audits, _ranked(audits)


def chain(children: list[tuple[list, list]]) -> dict[tuple[int, int], tuple]:
    """(cost, ranks along the way, states along the way) of the best way through
    adjacent blocks (costs, ranks), for every pair of states that has one. Two ways
    from one state part at a common state, where the ranks order them."""
    ways = {}
    for s in range(4):
        front = {s: (0, (), (s,))}
        for costs, ranks in children:
            ahead: dict[int, tuple] = {}
            for x, (cost, key, path) in front.items():
                for y in range(4):
                    if costs[4 * x + y] is not None:
                        new = (cost + costs[4 * x + y], (*key, ranks[4 * x + y]), (*path, y))
                        if y not in ahead or new < ahead[y]:
                            ahead[y] = new
            front = ahead
        ways |= {(s, e): way for e, way in front.items()}
    return ways


# ------------------------------------------------------------------ the jobs

def damaged(rows: DataFrame) -> DataFrame:
    """The rows with the damage that op13 prescribes, by crc32(conv_id:turn) % 20:
    0 drops a row (kept here as ``gone``), 1 empties its text, 2 removes ``.!?``,
    3 repeats it, 4 makes its role user. Nulls count as one blank."""
    blank = F.lit(" ")
    whole = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    fate = F.crc32(F.concat(whole("conv_id"), F.lit(":"), whole("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", whole("role").alias("role"), whole("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))
    out = out.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
                     text.alias("text"), (F.col("fate") == 0).alias("gone"), F.explode(copies).alias("copy"))
    return out.drop("copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``ORDER``; a missing ``gone`` is false."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), whole("role").alias("role"), whole("text").alias("text"), gone.alias("gone"))
    return out.withColumns({"head": F.left("text", F.lit(HEAD)), "h": F.xxhash64("role", "text")})


def _with(left: DataFrame, right: DataFrame, key: str | None = None, to: str | None = None) -> DataFrame:
    """Inner join on conv_id (nulls are equal) and, if given, left ``key`` = right
    ``to``; the right side's own keys are dropped."""
    right = right.withColumnRenamed("conv_id", "__conv")
    same = F.col("conv_id").eqNullSafe(F.col("__conv"))
    if key:
        right = right.withColumnRenamed(to, "__key")
        return left.join(right, same & (F.col(key) == F.col("__key"))).drop("__conv", "__key")
    return left.join(right, same).drop("__conv")


def _blocks(keyed: DataFrame) -> DataFrame:
    """(conv_id, blk, start, rows): each block's rows (turn, code) in order, its
    first row's place in ``ORDER``. code: role initial and fault (B, D, T or -)."""
    spark = keyed.sparkSession
    seen = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(seen == "", "B").when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), "T").otherwise("-")
    initial = F.coalesce(F.nullif(F.left("role", F.lit(1)), F.lit("")), F.lit("-"))
    light, light_path = C.stage(keyed.select(*ORDER, F.xxhash64(F.lit(1), "role", "text").alias("h2"), "gone", initial.alias("initial"), fault.alias("fault")))
    # Rows equal in the whole order are alike, so they may be dealt anywhere.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = light.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts, *ORDER, "salt").sortWithinPartitions(*ORDER)
    dealt, dealt_path = C.stage(dealt.drop("salt").withColumn("seq", F.monotonically_increasing_id()))
    firsts = dealt.where("NOT gone AND fault <> 'B'").groupBy("conv_id", "h", "h2").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("new"))
    own = F.when((F.col("fault") != "B") & F.col("new").isNull(), "D").otherwise(F.col("fault"))
    rows = dealt.join(firsts, "seq", "left").withColumn("code", F.when(~F.col("gone"), F.concat("initial", own)))
    found = rows.groupBy("conv_id", F.shiftright("seq", BLOCK_BITS).alias("blk")).agg(
        F.min(F.struct("seq", "turn", "role", "head", "h")).alias("start"),
        F.sort_array(F.collect_list(F.when(~F.col("gone"), F.struct("seq", "turn", "code")))).alias("rows"))
    blocks, _ = C.stage(found)
    C.drop(spark, light_path, dealt_path)
    return blocks


def _solved(blocks: DataFrame, kind: str) -> DataFrame:
    """Each block with its facts, costs, audits and ranks, and whether it is its
    conversation's first and last."""
    spans = blocks.groupBy("conv_id").agg(F.min("blk").alias("low"), F.max("blk").alias("high"))
    both = _with(blocks, spans).select(
        "conv_id", "blk", (F.col("blk") == F.col("low")).alias("first"), (F.col("blk") == F.col("high")).alias("last"), "start", "rows")
    longs, texts = pa.list_(pa.int64()), pa.list_(pa.string())

    def solve(batches):
        for batch in batches:
            out = []
            for first, last, rows in zip(*(batch.column(k).to_pylist() for k in (2, 3, 5))):
                out.append((_facts(rows), *solve_block(rows, first, last)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array([x[k] for x in out], t) for k, t in enumerate((longs, longs, texts, longs)))],
                                             names=["conv_id", "blk", "first", "last", "start", "facts", "costs", "audits", "ranks"])

    start = both.schema["start"].dataType.simpleString()
    return both.mapInArrow(solve, f"conv_id {kind}, blk long, first boolean, last boolean, start {start}, facts array<long>, costs array<long>, audits array<string>, ranks array<long>")


def _combined(nodes: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """For conversations of several blocks: (conv_id, facts, cost), and
    (conv_id, blk, entry, exit): the states before and behind each block."""
    longs = pa.list_(pa.int64())

    def merge(batches):
        for batch in batches:
            out = []
            for children in batch.column(2).to_pylist():
                facts = children[0]["facts"]
                for child in children[1:]:
                    facts = _joined(facts, child["facts"])
                ways = chain([(c["costs"], c["ranks"]) for c in children])
                costs, keys = [None] * 16, [None] * 16
                for (s, e), (cost, key, _) in ways.items():
                    costs[4 * s + e], keys[4 * s + e] = cost, key
                out.append((facts, costs, _ranked(keys)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([x[k] for x in out], longs) for k in range(3))],
                                             names=["conv_id", "blk", "facts", "costs", "ranks"])

    def descend(batches):
        for batch in batches:
            rows, to = [], []
            for n, (children, s, e) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))):
                path = chain([(c["costs"], c["ranks"]) for c in children])[s, e][2]
                rows += [(c["blk"], x, y) for c, x, y in zip(children, path, path[1:])]
                to += [n] * len(children)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(to, pa.int64())), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))],
                                             names=["conv_id", "blk", "entry", "exit"])

    levels = []
    while True:
        most = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
        if most <= 1 and levels:
            break
        parent = F.lit(0).cast("long") if most <= 1 << FAN_BITS else F.shiftright("blk", FAN_BITS)
        groups = nodes.groupBy("conv_id", parent.alias("parent")).agg(F.sort_array(F.collect_list(F.struct("blk", "facts", "costs", "ranks"))).alias("children"))
        levels.append(C.stage(groups)[0])
        nodes = C.cut(levels[-1].mapInArrow(merge, f"conv_id {kind}, blk long, facts array<long>, costs array<long>, ranks array<long>"))
    totals = nodes.select("conv_id", "facts", F.col("costs")[0].alias("cost"))
    ways = nodes.select("conv_id", "blk", F.lit(START).cast("long").alias("entry"), F.lit(START).cast("long").alias("exit"))
    for groups in reversed(levels):
        ways = _with(groups, ways, "parent", "blk").select("conv_id", "children", "entry", "exit")
        ways = C.cut(ways.mapInArrow(descend, f"conv_id {kind}, blk long, entry long, exit long"))
    return totals, ways


def _audits(blocks: DataFrame) -> DataFrame:
    """(conv_id, start, blk, audit, facts, cost) of every block; facts and cost of
    the whole conversation stand with its first block, else null."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    solved = C.stage(_solved(blocks, kind))[0]
    whole = solved.where("first AND last").select("conv_id", "start", "blk", F.col("audits")[0].alias("audit"), "facts", F.col("costs")[0].alias("cost"))
    parts = solved.where("NOT (first AND last)")
    if parts.isEmpty():
        return whole
    totals, ways = _combined(parts.select("conv_id", "blk", "facts", "costs", "ranks"), kind)
    with_way = _with(parts, ways, "blk", "blk").select(
        "conv_id", "start", "blk", "first", F.get("audits", (4 * F.col("entry") + F.col("exit")).cast("int")).alias("audit"))
    lead = F.col("first")
    joined = _with(with_way, totals).select(
        "conv_id", "start", "blk", "audit", F.when(lead, F.col("facts")).alias("facts"), F.when(lead, F.col("cost")).alias("cost"))
    return whole.unionByName(joined)


class _Writer:
    """One conversation as it streams by: audit letters queue up, each text row
    takes its own, insertions come in between."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.letters, self.at, self.place = conv_id, START, "", 0, 0
        self.parts: list[str] = []
        self.facts = self.cost = None
        self.digest = hashlib.sha256()

    def block(self, audit, facts, cost):
        self.letters, self.at = self.letters[self.at:] + audit, 0
        self.parts.append(audit)
        if facts is not None:
            self.facts, self.cost = facts, cost

    def _write(self, edit, role, text):
        self.digest.update((("\n" if self.place else "") + role + ":" + text).encode())
        self.place += 1
        return self.conv_id, self.place, edit, role, text

    def inserted(self):
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at, self.state = self.at + 1, AHEAD[self.state]
            yield self._write("I", ROLE[self.state], "")

    def row(self, role, text):
        yield from self.inserted()
        edit = self.letters[self.at]
        self.at += 1
        if edit == "K":
            self.state = kept(self.state, role[:1])
            yield self._write("K", role, text)
        elif edit == "R":
            self.state = AHEAD[self.state]
            yield self._write("R", ROLE[self.state], text)

    def report(self):
        f = self.facts
        gaps = 0 if f[1] is None else f[2] - f[1] + 1 - f[3]
        return (self.conv_id, gaps, *f[4:8], self.cost, "".join(self.parts), self.digest.hexdigest())


def _streamed(rows: DataFrame, reports: bool) -> DataFrame:
    """Reports of the conversations, or their repaired rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    keyed = _keyed(rows)
    blocks = _blocks(keyed)
    audits = _audits(blocks).select("conv_id", "start.turn", "start.role", "start.head", "start.h", F.lit(0).alias("kind"), "blk", "audit", "facts", "cost", F.lit(None).cast("string").alias("text"))
    texts = keyed.where(~F.col("gone")).select(*ORDER, F.lit(1).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("blk", "long"), ("audit", "string"), ("facts", "array<long>"), ("cost", "long"))], "text")
    dealt = audits.unionByName(texts).repartition("conv_id").sortWithinPartitions(*ORDER, "kind", "blk").select("conv_id", "role", "kind", "audit", "facts", "cost", "text")
    schema, types = ((f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string", [pa.int64()] * 6 + [pa.string()] * 2)
                     if reports else (f"conv_id {kind}, place long, edit string, role string, text string", [pa.int64()] + [pa.string()] * 3))

    def write(batches):
        now = None

        def ended():
            left = list(now.inserted()) if now else []
            return ([now.report()] if now else []) if reports else left

        for batch in batches:
            own, out = batch.schema.field("conv_id").type, []
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for conv_id, role, is_row, audit, facts, cost, text in zip(*columns):
                if now is None or conv_id != now.conv_id:
                    out += ended()
                    now = _Writer(conv_id)
                if is_row:
                    made = list(now.row(role, text))
                    out += [] if reports else made
                else:
                    now.block(audit, facts, cost)
            yield _batch(out, own, types, schema)
        if now:
            yield _batch(ended(), own, types, schema)

    return dealt.mapInArrow(write, schema)


def _batch(rows: list, own: pa.DataType, types: list, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([own, *types])],
                                      names=[f.strip().split(" ")[0] for f in schema.split(",")])


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations of ``rows`` (conv_id, turn, role, text):
    ``conv_id``, ``place`` (from 1), ``edit`` (K, R or I), ``role``, ``text``."""
    return _streamed(rows, False)


def reports(rows: DataFrame) -> DataFrame:
    """For every conversation of ``rows``: its gaps and faults, the cost and the
    audit of its repair, and the checksum of the repaired rows."""
    return _streamed(rows, True)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(damaged(C.table(spark, sf_dir, "conversations")))
