"""Conversation structure repair by Knuth's lightest-derivation agenda.

A conversation's turns are edited, as cheaply as can be, until the initials of
its roles read ``(s?(ua)+)?``: an optional system turn, then user and assistant in
alternation, or nothing. Keep costs 0, Rerole (to user or assistant) 2, Delete 3,
Insert (an empty user or assistant turn) 2; a truncated turn that stays adds 1;
blank and repeated turns must be deleted. Among the cheapest, the audit (the
edits' initials in order) that is least in ASCII wins.

Repairs are deductions over items ``(i, q)``: "turns i, i+1, ... can be finished
from state q", q being the state of the automaton of the pattern. The axioms are
the accepting states behind the last turn; an edit of turn i, or an insertion, and
an item make a further item, whose audit is the edit's initial before the item's
own. The agenda pops the item of least (cost, turns covered, audit): both of the
first grow strictly by one deduction or the other and none falls, so the functions
are superior, and putting a letter in front keeps the order of audits, so they are
monotone; the first derivation popped for an item is its lightest, and the search
ends when the goal, (0, start), is popped. From one item no two edits share an
initial, so audits need not be spelled out to be compared.

Conversations of up to ``ROWS`` turns and ``BYTES`` bytes, as counted, are shuffled
by id, sorted and repaired one after the other. Longer ones have a way that never
holds one whole: equal turns are counted and first occurrences found by aggregation,
the turns are dealt in order over range partitions, and each stretch of a conversation
inside a partition is summed up as its lightest cost from any state to any state,
with the order of the audits. The stretches of a conversation (at most one a
partition) are then composed from the right, each stretch traced between
the states so found, and the hash, which can only be taken in order, streams over
the sorted turns, holding the audit alone.

Defined results: null roles and texts are one space. Turns go by turn number (nulls
first), then role and text; a null id is a conversation of its own. A turn without
an initial that fits (an empty role, say) can only be reroled or deleted. Repeated
rows are turns of their own, hence duplicates. A conversation none of whose rows
is ``present`` gives zeros, an empty audit and the empty string's hash. Extra columns
are left out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACES, small, stage, table
from ledgerloom.llm.registry import query

#: Conversations beyond either go the long way.
ROWS, BYTES = 20_000, 8 << 20
#: Conversations a task returns at once.
OUT_ROWS = 4096

COST = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED_COST = 1
START, SYSTEM, USER, DONE = range(4)
ACCEPTING = (START, DONE)
#: The automaton of (s?(ua)+)?, and its arcs read backwards.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): DONE, (DONE, "u"): USER}
INTO = {q: [(p, c) for (p, c), t in NEXT.items() if t == q] for q in range(4)}
ROLE = {START: "user", SYSTEM: "user", USER: "assistant", DONE: "user"}
LEGAL = ("su", "ua", "au")
BLANK, REPEATED, TRUNCATED = "blank", "duplicate", "truncated"


def lightest(axioms, deductions, goal=None) -> dict:
    """Knuth's agenda: item -> (weight, what it was deduced by), up to the goal's item.

    ``axioms`` are (weight, item); ``deductions(item, weight)`` gives (weight, letter,
    item) for what follows from a final item, by superior and monotone functions.
    """
    agenda = [(w, "", item, None) for w, item in axioms]
    heapq.heapify(agenda)
    final = {}
    while agenda:
        weight, letter, item, source = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight, letter, source
        if item == goal:
            break
        for w, edit, new in deductions(item, weight):
            if new not in final:
                heapq.heappush(agenda, (w, edit, new, item))
    return final


def _edits(turns, end_inserts: bool = True):
    """The deductions over ``turns``, a sequence of (initial, first fault)."""
    n = len(turns)

    def deductions(item, weight):
        (i, q), (cost, covered) = item, weight
        if i:
            initial, fault = turns[i - 1]
            yield (cost + COST["D"], covered + 1), "D", (i - 1, q)
            if fault not in (BLANK, REPEATED):
                stays = cost + (TRUNCATED_COST if fault == TRUNCATED else 0)
                for p, c in INTO[q]:
                    if c == initial:
                        yield (stays + COST["K"], covered + 1), "K", (i - 1, p)
                    if c != "s":
                        yield (stays + COST["R"], covered + 1), "R", (i - 1, p)
        if i < n or end_inserts:
            for p, c in INTO[q]:
                if c != "s":
                    yield (cost + COST["I"], covered), "I", (i, p)
    return deductions


def _audit(final: dict, item) -> str:
    letters = []
    while item is not None:
        _, letter, item = final[item]
        letters.append(letter)
    return "".join(letters)


def cheapest(turns) -> tuple[int, str]:
    """(cost, audit) of the lightest repair of a sequence of (initial, first fault)."""
    goal = (0, START)
    final = lightest([((0, 0), (len(turns), q)) for q in ACCEPTING], _edits(turns), goal)
    return final[goal][0][0], _audit(final, goal)


def transfer(turns, last: bool) -> list[tuple]:
    """(from state, to state, cost, place of the audit among those from that state) of a stretch.

    Insertions behind a stretch belong to the next one, so no audit from a state
    is the beginning of another, and their order holds whatever follows.
    """
    out = []
    for end in range(4):
        final = lightest([((0, 0), (len(turns), end))], _edits(turns, last))
        out += [(q, end, final[0, q][0][0], _audit(final, (0, q))) for q in range(4) if (0, q) in final]
    out.sort(key=lambda t: (t[0], t[3]))
    return [(q, end, cost, place) for place, (q, end, cost, _) in enumerate(out)]


def _lines(edits: str, state: int, role: str, text: str):
    """((role, text) of what edits of one turn leave, state after it)."""
    out = []
    for e in edits:
        if e == "D":
            continue
        kept = role if e == "K" else ROLE[state]
        out.append((kept, "" if e == "I" else text))
        state = NEXT[state, kept[:1]]
    return out, state


def _illegal(initials) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _out(rows, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of ``OUT_ROWS`` rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema.names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema.names)


MEASURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("conv_id", id_type), *[(c, pa.int64()) for c in MEASURES],
                      ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _whole(batches: Iterator[pa.RecordBatch], id_type) -> Iterator[pa.RecordBatch]:
    """Repairs sorted (conv_id, turn, role, text, fault, present), conversation by conversation."""
    def repaired():
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            seen, turns, kept, numbers = set(), [], [], set()
            for _, turn, role, text, fault, present in rows:
                if not present:
                    continue
                if fault != BLANK and (role, text) in seen:
                    fault = REPEATED
                seen.add((role, text))
                turns.append((role[:1], fault))
                kept.append((role, text))
                if turn is not None:
                    numbers.add(turn)
            cost, audit = cheapest(turns)
            sha, state, at, first = hashlib.sha256(), START, iter(kept), True
            for e in audit:
                lines, state = _lines(e, state, *(next(at) if e != "I" else ("", "")))
                for role, text in lines:
                    sha.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                    first = False
            faults = [f for _, f in turns]
            yield (conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
                   faults.count(BLANK), faults.count(REPEATED), faults.count(TRUNCATED),
                   _illegal([c for c, _ in turns]), cost, audit, sha.hexdigest())
    return _out(repaired(), _schema(id_type))


def _id_of(alias: str):
    return F.col(f"{alias}.conv_id").eqNullSafe(F.col("t.conv_id"))


def _small_repairs(rows: DataFrame) -> DataFrame:
    id_type = _arrow(rows, "conv_id")
    sorted_ = rows.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.asc_nulls_first("turn"), "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return sorted_.select("conv_id", "turn", "role", "text", "fault", "present").mapInArrow(
        lambda batches: _whole(batches, id_type),
        f"conv_id {kind}, " + ", ".join(f"{c} long" for c in MEASURES) + ", audit string, repaired_sha256 string")


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _stretches(batches, id_type) -> Iterator[pa.RecordBatch]:
    """Sums up every (conv_id, part) of sorted (conv_id, part, seq, initial, fault, n, last)."""
    def summed():
        for (conv, part), rows in groupby(_rows(batches), key=lambda r: r[:2]):
            turns, last = [], False
            for _, _, _, initial, fault, n, last in rows:
                turns += [(initial, fault)] + [(initial, BLANK if fault == BLANK else REPEATED)] * (n - 1)
            faults = [f for _, f in turns]
            yield (conv, part, faults.count(BLANK), faults.count(REPEATED), faults.count(TRUNCATED),
                   _illegal([c for c, _ in turns]), turns[0][0], turns[-1][0],
                   [x for t in transfer(turns, last) for x in t])
    return _out(summed(), pa.schema([("conv_id", id_type), ("part", pa.int64()), *[
        (c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")],
        ("first", pa.string()), ("last", pa.string()), ("transfer", pa.list_(pa.int64()))]))


def _composed(batches, id_type) -> Iterator[pa.RecordBatch]:
    """Composes the stretches of each conversation, sorted from the right; the first row of all has the cost."""
    def composed():
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            best = {q: 0 for q in ACCEPTING}
            choices, after, across = [], None, 0
            for _, part, first, last, flat in rows:
                across += after is not None and last + after not in LEGAL
                after = first
                now, chosen = {}, {}
                for k in range(0, len(flat), 4):
                    q, end, cost, place = flat[k:k + 4]
                    if end in best and (cost + best[end], place) < now.get(q, (float("inf"), 0)):
                        now[q], chosen[q] = (cost + best[end], place), end
                best = {q: c for q, (c, _) in now.items()}
                choices.append((part, chosen))
            q, cost = START, best[START]
            for k, (part, chosen) in enumerate(reversed(choices)):
                yield conv, part, q, chosen[q], cost if k == 0 else 0, across if k == 0 else 0
                q = chosen[q]
    return _out(composed(), pa.schema([("conv_id", id_type), ("part", pa.int64()), ("enter", pa.int32()),
                                       ("leave", pa.int32()), ("cost", pa.int64()), ("across", pa.int64())]))


def _traced(batches, id_type) -> Iterator[pa.RecordBatch]:
    """The edits of every turn of sorted (conv_id, part, seq, role, text, fault, n, last, enter, leave)."""
    def traced():
        for (conv, part), rows in groupby(_rows(batches), key=lambda r: r[:2]):
            turns, owner, held, last = [], [], [], False
            for _, _, seq, role, text, fault, n, last, enter, leave in rows:
                turns += [(role[:1], fault)] + [(role[:1], BLANK if fault == BLANK else REPEATED)] * (n - 1)
                owner += [len(held)] * n
                held.append((seq, role, text))
            final = lightest([((0, 0), (len(turns), leave))], _edits(turns, last))
            edits, at = [[] for _ in held], 0
            for e in _audit(final, (0, enter)):
                edits[owner[min(at, len(owner) - 1)]].append(e)
                at += e != "I"
            for (seq, role, text), letters in zip(held, edits):
                letters = "".join(letters)
                stays = "K" in letters or "R" in letters
                yield conv, seq, letters, role if stays else "", text if stays else ""
    return _out(traced(), pa.schema([("conv_id", id_type), ("seq", pa.int64()), ("edits", pa.string()),
                                     ("role", pa.string()), ("text", pa.string())]))


def _hashed(batches, id_type) -> Iterator[pa.RecordBatch]:
    """(conv_id, audit, repaired_sha256) of sorted (conv_id, seq, edits, role, text), streamed."""
    def hashed():
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            sha, state, first, audit = hashlib.sha256(), START, True, []
            for _, _, edits, role, text in rows:
                audit.append(edits)
                lines, state = _lines(edits, state, role, text)
                for r, t in lines:
                    sha.update(("" if first else "\n").encode() + f"{r}:{t}".encode())
                    first = False
            yield conv, "".join(audit), sha.hexdigest()
    return _out(hashed(), pa.schema([("conv_id", id_type), ("audit", pa.string()), ("repaired_sha256", pa.string())]))


def _large_repairs(rows: DataFrame) -> DataFrame:
    """The same result without ever holding a conversation."""
    id_type, kind = _arrow(rows, "conv_id"), rows.schema["conv_id"].dataType.simpleString()
    ids = rows.select("conv_id").distinct()
    there = rows.where("present").groupBy("conv_id", "turn", "role", "text", "fault").agg(F.count("*").alias("n"))
    there = stage(there.withColumn("key", F.sha2(F.concat("role", F.lit("\0"), "text"), 256)), "turns")
    order = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    firsts = there.groupBy(F.col("conv_id").alias("f_id"), F.col("key").alias("f_key")).agg(F.min(order).alias("least"))
    marked = there.join(firsts, F.col("conv_id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_key"))) \
        .withColumn("fault", F.when((F.col("fault") != BLANK) & ~F.col("turn").eqNullSafe(F.col("least.turn")),
                                    F.lit(REPEATED)).otherwise(F.col("fault")))
    by = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    ordered = marked.select("conv_id", "turn", "role", "text", "fault", "n").repartitionByRange(*by) \
        .sortWithinPartitions(*by).withColumn("seq", F.monotonically_increasing_id()) \
        .withColumn("part", F.shiftright("seq", 33))
    turns = stage(ordered, "ordered-turns")
    ends = stage(turns.groupBy(F.col("conv_id").alias("e_id")).agg(F.max("part").alias("e_part")), "ends")
    turns = turns.join(small(ends, ends.count()), F.col("conv_id").eqNullSafe(F.col("e_id"))) \
        .withColumn("last", F.col("part") == F.col("e_part"))

    def in_order(df):
        return df.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "seq")

    stretches = stage(in_order(turns.select("conv_id", "part", "seq", F.substring("role", 1, 1).alias("initial"),
                                            "fault", "n", "last"))
                      .mapInArrow(lambda b: _stretches(b, id_type), f"conv_id {kind}, part long, blank long, "
                                  "duplicate long, truncated long, illegal long, first string, last string, "
                                  "transfer array<long>"), "stretches")
    plan = stage(stretches.select("conv_id", "part", "first", "last", "transfer").repartition("conv_id")
                 .sortWithinPartitions("conv_id", F.desc("part"))
                 .mapInArrow(lambda b: _composed(b, id_type), f"conv_id {kind}, part long, enter int, leave int, "
                             "cost long, across long"), "plan")
    states = plan.select(F.col("conv_id").alias("p_id"), F.col("part").alias("p_part"), "enter", "leave")
    edited = in_order(turns.join(small(states, states.count()), F.col("conv_id").eqNullSafe(F.col("p_id")) & (
        F.col("part") == F.col("p_part")))).select("conv_id", "part", "seq", "role", "text", "fault", "n", "last",
                                                  "enter", "leave") \
        .mapInArrow(lambda b: _traced(b, id_type), f"conv_id {kind}, seq long, edits string, role string, text string")
    hashes = edited.repartition("conv_id").sortWithinPartitions("conv_id", "seq") \
        .mapInArrow(lambda b: _hashed(b, id_type), f"conv_id {kind}, audit string, repaired_sha256 string")
    numbers = turns.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))
    counts = stretches.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    costs = plan.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sum("across").alias("across"))
    out = ids.alias("t")
    for name, part in (("g", numbers), ("c", counts), ("p", costs), ("h", hashes)):
        out = out.join(part.alias(name), _id_of(name), "left")
    zero = F.lit(0).cast("long")
    return out.select("t.conv_id", F.coalesce("gaps", zero).alias("gaps"),
                      *[F.coalesce(c, zero).alias(c) for c in ("blank", "duplicate", "truncated")],
                      F.coalesce(F.col("illegal") + F.col("across"), zero).alias("illegal"),
                      F.coalesce("cost", zero).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repair(rows: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text",
           present_col: str | None = None, max_rows: int = ROWS, max_bytes: int = BYTES) -> DataFrame:
    """One row per conversation: conv_id, ``MEASURES``, audit, repaired_sha256.

    Rows whose ``present_col`` is false only say that the conversation exists.
    """
    text = F.coalesce(F.col(text_col), F.lit(" "))
    ink = F.rtrim(text, F.lit(SPACES))
    fault = F.when(ink == "", BLANK).when(F.substring(ink, -1, 1).isin(*".!?"), "").otherwise(TRUNCATED)
    rows = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                       F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), text.alias("text"), fault.alias("fault"),
                       (F.col(present_col) if present_col else F.lit(True)).alias("present"))
    sizes = rows.groupBy(F.col("conv_id").alias("long_id")).agg(
        F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("b"))
    long_ids = stage(sizes.where((F.col("n") > max_rows) | (F.col("b") > max_bytes)).select("long_id"), "long")
    n_long = long_ids.count()
    if not n_long:
        return _small_repairs(rows)
    mark, same = small(long_ids, n_long), F.col("conv_id").eqNullSafe(F.col("long_id"))
    return _small_repairs(rows.join(mark, same, "left_anti")).unionByName(
        _large_repairs(rows.join(mark, same, "left_semi")))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults by a hash of id and turn; dropped rows are not ``present``."""
    def shown(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"),
                                F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")),
                                       F.lit(20)).alias("_hurt"))
    text = F.when(F.col("_hurt").isin(0, 1), "").when(F.col("_hurt") == 2, F.translate("text", ".!?", "")) \
        .otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("_hurt") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), (F.col("_hurt") != 0).alias("present"),
                       F.explode(F.sequence(F.lit(1), F.when(F.col("_hurt") == 3, 2).otherwise(1))).alias("_copy")) \
        .drop("_copy")


@query("op12_conversation_repair")
def op12_conversation_repair(spark, sf_dir) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")), present_col="present")
