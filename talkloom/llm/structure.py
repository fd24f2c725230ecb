"""Repair of the turn structure of conversations: cheapest edits that make the roles a legal sequence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from talkloom.llm.common import partitions_for

#: What counts as white space, and what ends a sentence.
SPACE = r"\x20\x09-\x0D"
STOPS = ".!?"
#: Grammar of role initials (s?(ua)+)?: states are nothing yet, system, user, assistant last.
START, SYSTEM, USER, ASSISTANT = range(4)
TAKES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The only turn that may be put into a state (an inserted or renamed turn is never a system one).
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Costs of the end of a conversation: turns that are still missing are inserted.
RENAME, DELETE, INSERT, UNSTOPPED = 2, 3, 2, 1
END = (0, 2 * INSERT, INSERT, 0)


def before(after: tuple, initial: str, fault: str) -> tuple:
    """Costs to go in front of a row, by state, from those behind it."""
    free = fault not in ("blank", "duplicate")
    extra = UNSTOPPED if fault == "truncated" else 0
    own = []
    for state in range(4):
        best = DELETE + after[state]
        if free:
            to = TAKES[state].get(initial)
            if to is not None:
                best = min(best, extra + after[to])
            best = min(best, RENAME + extra + after[NEXT[state]])
        own.append(best)
    user = min(own[USER], INSERT + own[ASSISTANT])
    return min(own[START], INSERT + user), min(own[SYSTEM], INSERT + user), user, min(own[ASSISTANT], INSERT + own[USER])


def edits(state: int, after: tuple, initial: str, fault: str) -> tuple[str, int]:
    """The ASCII-least cheapest edits up to and with a row's own: their initials and the state behind them."""
    costs = before(after, initial, fault)
    free = fault not in ("blank", "duplicate")
    extra = UNSTOPPED if fault == "truncated" else 0
    done = ""
    while True:
        left = costs[state]
        if left == DELETE + after[state]:
            return done + "D", state
        if left == INSERT + costs[NEXT[state]]:
            done, state = done + "I", NEXT[state]
            continue
        to = TAKES[state].get(initial) if free else None
        if to is not None and left == extra + after[to]:
            return done + "K", to
        return done + "R", NEXT[state]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Batches with the columns as lists, and for each row whether a new conversation begins there."""
    last, some = None, False
    for batch in batches:
        if batch.num_rows:
            convs = batch.column(0).to_pylist()
            new = [not some or convs[0] != last, *[a != b for a, b in zip(convs, convs[1:], strict=False)]]
            last, some = convs[-1], True
            yield batch, new


def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, the last of each conversation first, with the costs to go behind them, by state."""
    known: dict = {}
    costs = END
    for batch, new in _keyed(batches):
        out = [[], [], [], []]
        for fresh, initial, fault in zip(new, batch.column("initial").to_pylist(), batch.column("fault").to_pylist(), strict=True):
            if fresh:
                costs = END
            for column, cost in zip(out, costs, strict=True):
                column.append(cost)
            least = min(costs)
            key = (initial if initial in ("s", "u", "a") else "", fault, *[c - least for c in costs])
            ahead = known.get(key)
            if ahead is None:
                ahead = known[key] = before(key[2:], key[0], fault)
            costs = tuple(least + c for c in ahead)
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.int64()) for c in out]], names=[*batch.schema.names, "c0", "c1", "c2", "c3"])


def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in order, each behind the turns inserted before it, with its edit; missing turns at the end."""
    names = ["conv", "place", "turn", "edit", "fault", "cost", "was", "role", "text"]
    state, place, conv = START, 0, None
    schema = None
    out: list[list] = [[] for _ in names]

    def put(*row):
        for column, value in zip(out, row, strict=True):
            column.append(value)

    def insert(where):
        nonlocal state, place
        state = NEXT[state]
        put(where, place, None, "I", None, INSERT, None, ROLE[state], "")
        place += 1

    def finish(where):
        while state not in (START, ASSISTANT):
            insert(where)

    def flush():
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema, strict=True)], names=names)
        for column in out:
            column.clear()
        return made

    some = False
    for batch, new in _keyed(batches):
        if schema is None:
            text = pa.string()
            schema = [batch.column(0).type, pa.int64(), pa.int64(), text, text, pa.int64(), text, text, text]
        columns = [batch.column(n).to_pylist() for n in ("conv", "turn", "role", "text", "initial", "fault", "c0", "c1", "c2", "c3")]
        for fresh, (here, turn, role, text, initial, fault, *after) in zip(new, zip(*columns, strict=True), strict=True):
            if fresh:
                if some:
                    finish(conv)
                state, place, conv, some = START, 0, here, True
            done, to = edits(state, tuple(after), initial, fault)
            for _ in done[:-1]:
                insert(conv)
            edit = done[-1]
            state = to
            cost = DELETE if edit == "D" else RENAME * (edit == "R") + UNSTOPPED * (fault == "truncated")
            put(conv, place, turn, edit, fault, cost, role, None if edit == "D" else ROLE[state] if edit == "R" else role, None if edit == "D" else text)
            place += 1
        yield flush()
    if some:
        finish(conv)
        yield flush()


def repaired_turns(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every row and every inserted turn in order: conv, place, turn, edit, fault, cost, was, role, text.

    Rows of a conversation stand by turn (nulls first), ties by role and text.  A row's first fault counts: blank (only
    white space), duplicate (role and text seen earlier in the conversation), truncated (does not end in a
    stop).  edit is K (kept), R (role renamed to user or assistant), D (deleted, which blank and duplicate
    rows must be) or I (empty turn inserted); the edits are the cheapest ones whose role initials read
    (s?(ua)+)?, of several the ASCII-least.  role and text are the repaired ones, null where deleted; was is
    the role before.  Partitions hold whole conversations and are sorted by place.

    One shuffle by conversation; then duplicates are numbered, costs to go run backward and edits forward,
    each over rows that Spark has sorted, with four numbers of state, so a conversation of any length needs
    no more memory.  It is one task: the digest of its text is one chain.

    Nulls: a null role or text is one space (so a null text is blank), an empty role has no initial that is
    legal, null conversations are one
    conversation.  Texts may be of any length; a worker holds one Arrow batch of whole ones.  An empty table
    gives an empty table; other columns, whatever their names, are not looked at.
    """
    space = F.lit(" ")
    rows = conversations.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), space).alias("role"), F.coalesce(F.col(f"`{text_col}`"), space).alias("text"),
    )
    seen = F.row_number().over(W.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(~F.col("text").rlike(f"[^{SPACE}]"), "blank").when(F.col("seen") > 1, "duplicate").when(~F.col("text").rlike(rf"[{STOPS}][{SPACE}]*\z"), "truncated").otherwise("")
    marked = rows.repartition(partitions_for(rows), "conv").withColumn("seen", seen).withColumns({"fault": fault, "initial": F.substring("role", 1, 1)}).drop("seen")
    order = ["turn", "role", "text"]
    last_first = marked.sortWithinPartitions("conv", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("fault"))
    kind = marked.schema["conv"].dataType.simpleString()
    costed = last_first.mapInArrow(backward, f"conv {kind}, turn long, role string, text string, fault string, initial string, c0 long, c1 long, c2 long, c3 long")
    in_order = costed.sortWithinPartitions("conv", *order, "fault")
    return in_order.mapInArrow(forward, f"conv {kind}, place long, turn long, edit string, fault string, cost long, was string, role string, text string")


LEGAL = {"su", "ua", "au"}


class _Report:
    """What is carried along the repaired turns of one conversation."""

    def __init__(self):
        self.least = self.most = self.last = None
        self.turns = self.illegal = self.cost = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.audit, self.text, self.some = bytearray(), hashlib.sha256(), False

    def add(self, turn, edit, fault, cost, was, role, text):
        self.audit += edit.encode()
        self.cost += cost
        if edit != "I":
            if self.last is not None and self.last[:1] + was[:1] not in LEGAL:
                self.illegal += 1
            self.last = was
            if fault:
                self.faults[fault] += 1
            if turn is not None and turn != self.most:
                self.turns += 1
                self.least, self.most = turn if self.least is None else self.least, turn
        if edit != "D":
            self.text.update(("\n" if self.some else "").encode() + f"{role}:{text}".encode())
            self.some = True

    def row(self):
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (gaps, *self.faults.values(), self.illegal, self.cost, self.audit.decode(), self.text.hexdigest())


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    report, conv, kind = None, None, None

    def made(rows):
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch, new in _keyed(batches):
        kind, rows = batch.column(0).type, []
        columns = [batch.column(n).to_pylist() for n in ("conv", "turn", "edit", "fault", "cost", "was", "role", "text")]
        for fresh, (here, *values) in zip(new, zip(*columns, strict=True), strict=True):
            if fresh:
                if report is not None:
                    rows.append((conv, *report.row()))
                report, conv = _Report(), here
            report.add(*values)
        if rows:
            yield made(rows)
    if report is not None:
        yield made([(conv, *report.row())])


def repair_report(conversations: DataFrame, **columns: str) -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps counts turn numbers missing between the first and the last one, illegal the neighbouring rows whose
    role initials no legal sequence has; both look at the rows as they came.  audit joins the edits of
    repaired_turns(), whose handling of nulls, ties and long texts holds here too; the digest is of the
    repaired turns as role:text, one to a line.
    """
    turns = repaired_turns(conversations, **columns)
    kind = turns.schema["conv"].dataType.simpleString()
    return turns.mapInArrow(_reports, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults, by the CRC-32 of conv_id:turn modulo 20: dropped, emptied, without stops, repeated, made a user's."""
    clean = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    lot = clean.withColumn("lot", F.crc32(key) % 20).where("lot <> 0")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return lot.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")
