"""Compaction of threads: the rules over whole lists of messages, streams against walks, threads that are stuck."""

import random

import pytest
from pyspark.sql import functions as F

from talkloom.operators import compaction
from talkloom.operators.compaction import Rules, Thread, Turn

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Plain:
    """The rules written out over lists of messages (kind, characters, turn, name), rebuilt whole for every look."""

    def __init__(self, rules):
        self.r, self.turns, self.cut, self.keep, self.cleared, self.stuck, self.recalls = rules, [], None, None, None, None, {}

    def sent(self, at):
        r, out = self.r, []
        keep = self.keep if self.keep is not None else (10**9 if r.keep_turns is None else r.keep_turns)
        turns = self.turns
        for i, t in enumerate(turns):
            capped = r.turn_cap is not None and 0 < i < len(turns) - 1 and not t.pinned and t.chars > r.turn_cap / r.ratio
            if i >= max(at, 0) or at <= 0:
                out.append(("live", t.short if capped else t.chars))
        if 0 < at < len(turns):
            start = max(1, at - keep)
            head, gone = turns[0], []
            if head.pinned:
                out.append(("head", head.chars))
            elif start == 1 and head.messages > 1:
                out.append(("head", head.short))
            else:
                out.append(("head", head.opening))
                gone.append(head)
            for i in range(1, at):
                if turns[i].pinned:
                    out.append(("pin", turns[i].chars))
                elif i >= start:
                    out.append(("short", turns[i].short))
                else:
                    gone.append(turns[i])
            used, names = 0, []
            for name, n in [x for t in gone for x in t.notes][::-1]:
                if name in names or used + n > compaction.CARRIED_CHARS:
                    continue
                names.append(name)
                used += n
            out.append(("notice", r.notice + used))
        total = sum(n for _, n in out)
        left = self.cleared or 0
        for t in turns[max(at, 0) :]:
            for n in t.results:
                if left > 0:
                    left -= 1
                    total -= n - r.stub if n > r.stub else 0
        return total

    def estimate(self, at):
        return int((self.fixed + self.sent(at)) * self.r.ratio + 0.5)

    def request(self, seq, number, turn, fixed, window, may, recall):
        r = self.r
        self.turns, self.fixed, acts = [*self.turns[:number], turn], fixed, []
        names = [t.key for t in self.turns]
        at = names.index(self.cut) if self.cut in names else -1
        if self.cut is not None and at < 0:
            self.cut = self.keep = self.cleared = self.stuck = None

        def move(to, act):
            self.cut, self.keep, self.cleared, self.stuck = names[to], None, None, None
            self.recalls = {k: v for k, v in self.recalls.items() if k not in names[:to]}
            acts.append(act)
            return to

        if may and r.budget is not None:
            to = len(names) - 1 - r.keep
            while to > 1 and self.turns[to].interrupted:
                to -= 1
            base = int(fixed * r.ratio + 0.5)
            if to >= 1 and to > at and int((fixed + sum(t.chars for t in self.turns[max(at, 0) : to])) * r.ratio + 0.5) - base > r.budget:
                at = move(to, "roll")
        limit = None if window is None else r.compact_at * window
        if may and limit is not None and self.estimate(at) > limit:
            if len(names) - 1 > max(at, 0):
                at = move(len(names) - 1, "cut")
            base = int(fixed * r.ratio + 0.5)
            target = base + 0.3 * max(0, window - base)
            old = (self.keep, self.cleared, list(acts), self.estimate(at) > window) if self.stuck is not None else None
            was = self.stuck
            while self.estimate(at) > target:
                keep = min(self.keep if self.keep is not None else (10**9 if r.keep_turns is None else r.keep_turns), at - 1)
                if at > 0 and keep > 0:
                    self.keep = keep - 1
                    acts.append(f"keep={self.keep}")
                    continue
                left = sum(len(t.results) for t in self.turns[max(at, 0) :]) - (self.cleared or 0) - 5
                if left <= 0:
                    acts.append("stuck")
                    break
                self.cleared = (self.cleared or 0) + -(-left // 2)
                acts.append(f"cleared={self.cleared}")
            if old is not None:
                now = self.estimate(at)
                if not (now <= limit or (old[3] and now <= window)):
                    self.keep, self.cleared, acts, self.stuck = old[0], old[1], old[2], was
            now = self.estimate(at)
            if now > limit:
                self.stuck = now
            else:
                self.stuck = None
                if acts and acts[-1] == "stuck":
                    acts.pop()
        else:
            self.stuck = None
        if recall is not None and turn.key not in self.recalls:
            self.recalls[turn.key] = recall
        return seq, number, "compact" if at > 0 else "full", ",".join(acts), at if at > 0 else None, self.keep, self.cleared, self.stuck, self.estimate(at), len(self.recalls)


def history(rng, n):
    """Requests of one thread: turns that open, grow, are rewound and rewritten."""
    out, number, keys, grown = [], -1, 0, None
    for seq in range(n):
        if grown is None or rng.random() < 0.5:
            number, keys = number + 1, keys + 1
            grown = Turn(f"k{keys}", 0, 0, rng.randint(10, 300), 1, [(f"n{rng.randint(0, 9)}", rng.randint(10, 200))] * rng.randint(0, 2), [], rng.random() < 0.2, rng.random() < 0.1)
        elif rng.random() < 0.06 and number > 1:
            number, keys = rng.randint(0, number - 1), keys + 1
            grown = Turn(f"k{keys}", 0, 0, 50)
        more = [rng.choice([20, 150, 900, 4000]) for _ in range(rng.randint(0, 4))]
        results = grown.results + more
        grown = Turn(grown.key, grown.opening + 60 * len(results) + sum(results), grown.opening + 30, grown.opening, 1 + len(results), grown.notes, results, grown.interrupted, grown.pinned)
        out.append((seq, number, grown, 2000, rng.choice([None, 4000, 4000, 4000, 8000]), rng.random() < 0.95, rng.choice([None, "text", ""])))
    return out


RULES = [Rules(budget=None, turn_cap=None), Rules(budget=600, keep=2, turn_cap=1500), Rules(keep_turns=3, budget=None), Rules(keep_turns=0, budget=300, keep=1)]


@pytest.mark.parametrize("k", range(len(RULES)))
def test_thread_equals_the_rules_written_out(k):
    rng, acts = random.Random(k), set()
    for _ in range(60):
        thread, plain = Thread(RULES[k]), Plain(RULES[k])
        for row in history(rng, 45):
            got = thread.request(*row)
            assert got == plain.request(*row)
            acts |= {a.split("=")[0] for a in got[3].split(",")}
    assert {"cut", "cleared", "stuck"} <= acts and ("roll" in acts) == (RULES[k].budget is not None)


def as_rows(thread, requests):
    for seq, number, t, fixed, window, may, recall in requests:
        yield (thread, seq, number, t.key, t.chars, t.short, t.opening, t.messages, [tuple(n) for n in t.notes], t.results, t.interrupted, t.pinned, fixed, window, may, recall)


def test_walk_and_stream_agree(spark, tmp_path):
    rng, rules = random.Random(9), RULES[1]
    threads = {f"t{n}": history(rng, 30) for n in range(6)} | {None: history(rng, 10)}
    rows = [r for k, v in threads.items() for r in as_rows(k, v)]
    df = spark.createDataFrame(rows, compaction.REQUEST)
    want = []
    for k, v in threads.items():
        thread = Thread(rules)
        want += [(k, *thread.request(*r)) for r in v]
    walked = compaction.compacted(df.repartition(3), rules)
    assert sorted(map(tuple, walked.collect()), key=repr) == sorted(want, key=repr)
    # a stream in batches, stopped in between
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for low in range(0, 30, 10):
            df.where((F.col("seq") >= low) & (F.col("seq") < low + 10) & F.col("thread").isNotNull()).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
            query = compaction.compaction_stream(source, rules).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").start(f"{tmp_path}/out")
            query.processAllAvailable()
            query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    streamed = spark.read.parquet(f"{tmp_path}/out").select(*walked.columns)
    assert sorted(map(tuple, streamed.collect()), key=repr) == sorted((w for w in want if w[0] is not None), key=repr)


def stuck_thread(pairs, chars=3_000):
    live = Turn("live", 650_000 + pairs * (chars + 220), 650_100, 650_060, 1 + 2 * pairs, [], [chars + 20] * pairs)
    return live


def test_a_stuck_thread_holds_what_it_cleared():
    """A live turn that cannot get under the target: cleared outputs stay as they are until the window would be passed."""
    thread = Thread(Rules(budget=None, turn_cap=None))
    thread.request(0, 0, Turn("a", 160, 60, 50, 2), 100, 200_000, True, None)
    thread.request(1, 1, Turn("b", 900, 80, 50, 4, [], [100]), 100, 200_000, True, None)
    notes = [thread.request(2 + i, 2, stuck_thread(30 + i), 100, 200_000, True, None) for i in range(40)]
    cleared = [n[6] for n in notes]
    assert len(set(cleared[:6])) == 1 and 3 <= len(set(cleared)) <= 5 and all(n[8] <= 200_000 for n in notes)
    assert all(n[7] is not None for n in notes[:6])
    changed = [i for i in range(1, 40) if cleared[i] != cleared[i - 1]]
    # it clears again only where holding would have passed the window
    for i in changed:
        thread.saved.cleared = cleared[i - 1]
        assert Thread(thread.rules, thread.turns[:2] + [stuck_thread(30 + i)], thread.saved)._shown(2) * thread.rules.ratio > 200_000 - 100


def test_stuck_ends_once_a_request_fits():
    thread = Thread(Rules(budget=None))
    thread.request(0, 0, Turn("a", 60, 60, 50), 100, 20_000, True, None)
    assert thread.request(1, 1, Turn("b", 90_000, 80, 50, 3, [], [89_000]), 100, 20_000, True, None)[7] is not None
    assert thread.request(2, 1, Turn("c", 300, 80, 50), 100, 20_000, True, None)[7] is None and thread.saved.stuck is None


def test_empty_and_null_requests(spark):
    assert compaction.compacted(spark.createDataFrame([], compaction.REQUEST)).count() == 0
    bare = compaction.compacted(spark.createDataFrame([(None, 1, 0, "k", *[None] * 12)], compaction.REQUEST)).collect()
    assert len(bare) == 1 and bare[0]["estimate"] == 0 and bare[0]["action"] == "full"
