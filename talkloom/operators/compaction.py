"""Compaction of threads under a window: cuts that roll, shrinking and holding, with state kept from request to request.

A row is one request: the thread, its order, the turn that is open in it and what that turn weighs.  The rules
feed back into themselves, so they run along each thread in order, either as a walk over a table or as a
stream with keyed state; both use `Thread`, which holds a few numbers for each turn and no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talkloom.operators.context import RATIO
from talkloom.operators.walks import walk

#: Fixed values of the rules: outputs that clearing leaves, characters of carried notes, the share of the window aimed at.
PROTECTED_OUTPUTS, CARRIED_CHARS, TARGET_SHARE = 5, 80_000, 0.3
ALL = 1 << 53

TURN = "chars long, short long, opening long, messages int, notes array<struct<id:string,chars:long>>, results array<long>, interrupted boolean, pinned boolean"
REQUEST = f"thread string, seq long, turn int, key string, {TURN}, fixed long, window long, may boolean, recall string"
NOTE = "seq bigint, turn int, action string, actions string, cut int, keep bigint, cleared bigint, stuck bigint, estimate bigint, recalls int"


@dataclass(frozen=True)
class Rules:
    """compact_at: the share of the window that may be used; keep_turns: turns shown in short in front of the cut
    (None: all); keep and budget: the rolling cut (budget None: none), budget in tokens; turn_cap: tokens from which
    a turn in the middle is shown in short; notice and stub: characters of the notice of a cut and of a cleared output."""

    compact_at: float = 0.9
    keep_turns: int | None = None
    keep: int = 3
    budget: int | None = 100_000
    turn_cap: int | None = 100_000
    ratio: float = RATIO
    notice: int = 600
    stub: int = 120


@dataclass
class Turn:
    key: str
    chars: int
    short: int
    opening: int
    messages: int = 1
    notes: list[tuple[str, int]] = field(default_factory=list)
    results: list[int] = field(default_factory=list)
    interrupted: bool = False
    pinned: bool = False


@dataclass
class Saved:
    """What a thread keeps between requests: the cut's turn key, turns shown in short, outputs cleared, the size it is stuck at."""

    cut: str | None = None
    keep: int | None = None
    cleared: int | None = None
    stuck: int | None = None


class Thread:
    """The turns of a thread so far and its saved state; request() takes one row and gives its note."""

    def __init__(self, rules: Rules, turns: list[Turn] | None = None, saved: Saved | None = None, recalls: dict[str, str] | None = None):
        self.rules, self.turns, self.saved, self.recalls = rules, turns or [], saved or Saved(), recalls or {}

    def request(self, seq: int, number: int, turn: Turn, fixed: int, window: int | None, may: bool, recall: str | None) -> tuple:
        """number: the open turn's place from 0; a place in front of the last turns means that history was rewound to it."""
        del self.turns[number:]
        self.turns.append(turn)
        at, actions = self._resolved(), []
        self.fixed = fixed
        if may and (due := self._due(at)) is not None:
            at = self._move(due, actions, "roll")
        limit = float("inf") if window is None else self.rules.compact_at * window
        if may and self.estimate(at) > limit:
            current = len(self.turns) - 1
            if current > 0 and current > at:
                at = self._move(current, actions, "cut")
            self._shrink_or_hold(at, actions, limit, window)
        else:
            self.saved.stuck = None
        if recall is not None:
            self.recalls.setdefault(turn.key, recall)
        cut, saved = at if at > 0 else None, self.saved
        return seq, number, "full" if cut is None else "compact", ",".join(actions), cut, saved.keep, saved.cleared, saved.stuck, self.estimate(at), len(self.recalls)

    def tokens(self, chars: float) -> int:
        """Rounded half up."""
        return int((self.fixed + chars) * self.rules.ratio + 0.5)

    def estimate(self, at: int) -> int:
        return self.tokens(self._shown(at))

    def _settled(self, place: int) -> int:
        while place > 1 and self.turns[place].interrupted:
            place -= 1
        return place

    def _resolved(self) -> int:
        """The saved cut's place; a cut whose turn is gone is forgotten with all that hangs on it."""
        if self.saved.cut is None:
            return -1
        found = next((i for i, t in enumerate(self.turns) if t.key == self.saved.cut), -1)
        if found < 0:
            self.saved = Saved()
        return found

    def _move(self, place: int, actions: list[str], action: str) -> int:
        self.saved = Saved(cut=self.turns[place].key)
        for turn in self.turns[:place]:
            self.recalls.pop(turn.key, None)
        actions.append(action)
        return place

    def _due(self, at: int) -> int | None:
        rules = self.rules
        if rules.budget is None:
            return None
        place = self._settled(len(self.turns) - 1 - rules.keep)
        if place < 1 or place <= at:
            return None
        backlog = self.tokens(sum(t.chars for t in self.turns[max(at, 0) : place])) - self.tokens(0)
        return place if backlog > rules.budget else None

    def _keep(self) -> int:
        if self.saved.keep is not None:
            return self.saved.keep
        return ALL if self.rules.keep_turns is None else self.rules.keep_turns

    def _shown(self, at: int) -> int:
        """Characters of the messages as they would be sent with the cut at this place."""
        turns, live = self.turns, max(at, 0)
        cap = None if self.rules.turn_cap is None else self.rules.turn_cap / self.rules.ratio
        last = len(turns) - 1

        def whole(i: int) -> int:
            turn = turns[i]
            return turn.short if cap is not None and 0 < i < last and not turn.pinned and turn.chars > cap else turn.chars

        total = sum(whole(i) for i in range(live, len(turns)))
        if 0 < at < len(turns):
            first = max(1, at - self._keep())
            opening = turns[0]
            folded = not opening.pinned and first == 1 and opening.messages > 1
            total += opening.chars if opening.pinned else opening.short if folded else opening.opening
            removed = [] if opening.pinned or folded else [opening]
            removed += [t for t in turns[1:first] if not t.pinned]
            total += self.rules.notice + self._carried(removed)
            total += sum(t.chars for t in turns[1:at] if t.pinned) + sum(t.short for t in turns[first:at] if not t.pinned)
        results = [r for t in turns[live:] for r in t.results]
        return total - sum(max(r - self.rules.stub, 0) for r in results[: self.saved.cleared or 0])

    @staticmethod
    def _carried(removed: list[Turn]) -> int:
        """Characters of the notes of removed turns that go on: each once, the newest first, while they fit."""
        seen, used = set(), 0
        for name, chars in (n for t in reversed(removed) for n in reversed(t.notes)):
            if name not in seen and used + chars <= CARRIED_CHARS:
                seen.add(name)
                used += chars
        return used

    def _shrink(self, at: int) -> str:
        """One step: a turn less in short, then half of the outputs that may be cleared."""
        keep = min(self._keep(), at - 1)
        if at > 0 and keep > 0:
            self.saved.keep = keep - 1
            return f"keep={self.saved.keep}"
        left = sum(len(t.results) for t in self.turns[max(at, 0) :]) - (self.saved.cleared or 0) - PROTECTED_OUTPUTS
        if left <= 0:
            return "stuck"
        self.saved.cleared = (self.saved.cleared or 0) + (left + 1) // 2
        return f"cleared={self.saved.cleared}"

    def _shrink_or_hold(self, at: int, actions: list[str], limit: float, window: int) -> None:
        """Shrink towards the target; a thread that was stuck keeps what it had unless shrinking brings it under the limit or back into the window."""
        fixed = self.tokens(0)
        target = fixed + TARGET_SHARE * max(0, window - fixed)
        held = None if self.saved.stuck is None else (replace(self.saved), len(actions), self.estimate(at) > window)
        while self.estimate(at) > target:
            actions.append(self._shrink(at))
            if actions[-1] == "stuck":
                break
        now = self.estimate(at)
        if held and now > limit and not (held[2] and now <= window):
            self.saved, now = held[0], None
            del actions[held[1] :]
        now = self.estimate(at) if now is None else now
        if now > limit:
            self.saved.stuck = now
        else:
            self.saved.stuck = None
            if actions and actions[-1] == "stuck":
                actions.pop()


def _turn(key: str, chars, short, opening, messages, notes, results, interrupted, pinned) -> Turn:
    """A turn from a row's values; nulls are nothing."""
    pair = lambda n: (n["id"], n["chars"]) if not isinstance(n, tuple) else n[:2]
    num = lambda x: 0 if x is None or pd.isna(x) else int(x)
    chars = num(chars)
    return Turn(
        key, chars, num(short), num(opening), max(1, num(messages)), [(i, num(c)) for i, c in map(pair, [] if notes is None else notes)],
        [num(r) for r in ([] if results is None else results)], interrupted is True or interrupted == 1, pinned is True or pinned == 1,
    )


VALUES = [c.split()[0] for c in TURN.split(", ")]
MORE = ["turn", "key", *VALUES, "fixed", "window", "may", "recall"]


def _take(thread: Thread, seq: int, number: int, key: str, *values: Any) -> tuple:
    *turn, fixed, window, may, recall = values
    known = lambda x: None if x is None or (not isinstance(x, str) and pd.isna(x)) else x
    window = known(window)
    return thread.request(int(seq), int(number), _turn(key, *turn), int(known(fixed) or 0), None if window is None else int(window), known(may) in (True, None, 1), known(recall))


def compacted(requests: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(thread, *NOTE): a note for each request, in order of seq along each thread.

    requests: REQUEST.  A thread's turns stay in memory as a few numbers each; its texts never do.  Null
    threads are one thread; null sizes are 0, a null window has no limit, a null `may` is true.
    """
    rules = rules or Rules()
    return walk(requests, key="thread", order="seq", values={c: F.col(c) for c in MORE}, start=lambda: Thread(rules), step=_take, schema=NOTE)


class Compactor(StatefulProcessor):
    """The state of a thread in three places: saved numbers (value), its turns and its recalls (maps), so that a request writes what it changed."""

    TURNS = f"key string, {TURN}"

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("saved", "cut string, keep long, cleared long, stuck long, turns int")
        self.turns = handle.getMapState("turns", "turn int", self.TURNS)
        self.recalls = handle.getMapState("recalls", "key string", "text string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["seq", "turn"], kind="stable")
        kept = self.saved.get() if self.saved.exists() else (None, None, None, None, 0)
        known = {k[0]: _turn(v[0], *v[1:]) for k, v in self.turns.iterator()} if kept[4] else {}
        recalls = {k[0]: v[0] for k, v in self.recalls.iterator()}
        thread = Thread(self.rules, [known[i] for i in range(kept[4])], Saved(*kept[:4]), dict(recalls))
        notes, least = [], kept[4]
        for row in frame[["seq", *MORE]].itertuples(index=False, name=None):
            notes.append(_take(thread, *row))
            least = min(least, notes[-1][1])
        for i in range(least, max(kept[4], len(thread.turns))):
            if i < len(thread.turns):
                t = thread.turns[i]
                self.turns.updateValue((i,), (t.key, t.chars, t.short, t.opening, t.messages, [tuple(n) for n in t.notes], t.results, t.interrupted, t.pinned))
            else:
                self.turns.removeKey((i,))
        for name in recalls.keys() - thread.recalls.keys():
            self.recalls.removeKey((name,))
        for name, text in thread.recalls.items():
            if name not in recalls:
                self.recalls.updateValue((name,), (text,))
        s = asdict(thread.saved)
        self.saved.update((*[s[f.name] for f in fields(Saved)], len(thread.turns)))
        out = pd.DataFrame(notes, columns=[c.split()[0] for c in NOTE.split(", ")])
        for name in ("cut", "keep", "cleared", "stuck"):
            out[name] = out[name].astype("Int64")
        out.insert(0, "thread", key[0])
        yield out

    def close(self) -> None:
        pass


def compaction_stream(requests: DataFrame, rules: Rules | None = None) -> DataFrame:
    """compacted() over a stream: requests of a batch are taken in order of seq, and each thread's state goes on to the next batch.

    Needs the state store that keeps several states for a key
    (spark.sql.streaming.stateStore.providerClass = ...execution.streaming.state.RocksDBStateStoreProvider).
    """
    return requests.groupBy("thread").transformWithStateInPandas(
        statefulProcessor=Compactor(rules or Rules()), outputStructType=f"thread string, {NOTE}", outputMode="Append", timeMode="None"
    )
