"""Manifest, sharding and structure repair against brute force, on real rows and on awkward ones."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from talkloom.llm import merkle, queries, sharding, structure

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree_of(leaves, arity=2):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def proof_in(levels, i, arity=2):
    out = []
    for below in levels[:-1]:
        run = i // arity * arity
        out.append((i - run, [h for j, h in enumerate(below[run : run + arity]) if run + j != i]))
        i //= arity
    return out


def fold(h, proof):
    for at, others in proof:
        h = H(*others[:at], h, *others[at:])
    return h


def manifest_of(rows, arity=2):
    """(doc_id, leaf, subroot, root, proof) of rows (doc_id, text, lang, source, n_chars)."""
    leaf = lambda r: H(*[framed(r[k]) for k in (0, 3, 2, 4, 1)])
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted(((r[0] is not None, r[0] or 0, leaf(r), r[0]) for r in rows if r[2] == lang), key=lambda x: x[:3])
        trees[lang] = mine, tree_of([m[2] for m in mine], arity)
    crown = tree_of([trees[lang][1][-1][0] for lang in langs], arity)
    out = []
    for k, lang in enumerate(langs):
        mine, levels = trees[lang]
        for i, (_, _, h, doc_id) in enumerate(mine):
            out.append((doc_id, h, levels[-1][0], crown[-1][0], proof_in(levels, i, arity) + proof_in(crown, k, arity)))
    return out


def docs_of(rng, n, langs):
    return [(rng.choice([i, i, i, None, 7]), rng.choice([None, "", "é" * 3, "x" * 50_000, f"text {i}"]), rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, i, 2**63 - 1])) for i in range(n)]


def plain(proof):
    return [(p["at"], list(p["others"])) for p in proof]


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_equals_brute_force(spark, monkeypatch, arity):
    monkeypatch.setattr(merkle, "BLOCK", 9)  # several tables of levels
    rows = docs_of(random.Random(1), 150, ["en"] * 8 + [None, "de", "", "ü", "z"])
    df = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(0).alias(c) for c in ("tree", "order", "hash", "load", "block", "levels", "id", "at", "proof")]).repartition(5)
    got = sorted((repr(r["id"]), r["leaf"], r["subroot"], r["root"], str(plain(r["proof"]))) for r in merkle.manifest(df, arity=arity).collect())
    want = manifest_of(rows, arity)
    # wholly equal rows have interchangeable places, so ids go with leaves
    assert got == sorted((repr(i), h, s, r, str(p)) for i, h, s, r, p in want)
    assert all(fold(h, p) == r for _, h, _, r, p in want)


def test_manifest_of_one_and_none(spark):
    one = merkle.manifest(spark.createDataFrame([(None, None, None, None, None)], DOCS)).collect()
    assert len(one) == 1 and one[0]["proof"] == [] and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] == H("-" * 5)
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_manifest_tells_tampering(spark, tmp_path):
    rows = docs_of(random.Random(2), 80, ["en", "de", None])
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_manifest(spark, str(tmp_path)).collect()
    bad = Counter(r["verified"] for r in got)
    hit = [r for r in rows if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0]
    assert len(got) == 80 and bad[False] == len(hit) > 0
    sums = {(i, h): (s, r, H(*[o for _, os in p for o in os])) for i, h, s, r, p in manifest_of(rows)}
    assert all((r["subroot"], r["root"]) == sums[r["doc_id"], r["leaf"]][:2] and r["verified"] == (r["folded_root"] == r["root"]) for r in got)
    assert Counter(r["proof_sha256"] for r in got) == Counter(H(*[o for _, os in p for o in os]) for *_, p in manifest_of(rows))


def pmf(g, b, d):
    whole = math.comb(g + b, d)
    return {x: math.comb(g, x) * math.comb(b, d - x) / whole for x in range(max(0, d - b), min(g, d) + 1)}


def test_hypergeometric_inverts_the_exact_distribution(spark):
    rng = random.Random(3)
    cases = [(rng.random(), rng.choice([0, 1, 5, 60, 700]), rng.choice([0, 1, 9, 80, 900])) for _ in range(400)]
    cases = [(u, g, b, rng.choice([0, g + b, rng.randint(0, g + b)])) for u, g, b in cases]
    df = spark.createDataFrame(cases, "u double, g long, b long, d long")
    for r in df.withColumn("x", sharding.hypergeometric(*[F.col(c) for c in "ugbd"])).collect():
        p = pmf(r["g"], r["b"], r["d"])
        mode = max(p, key=lambda x: (p[x], x))
        order = [*range(mode, max(p) + 1), *range(mode - 1, min(p) - 1, -1)]
        ends = list(itertools.accumulate(p[x] for x in order))
        at = order.index(r["x"])
        tied = mode - 1 in p and math.isclose(p[mode], p[mode - 1], rel_tol=1e-9)  # another mode, another order of the same values
        assert tied or (ends[at - 1] if at else 0) - 1e-9 <= r["u"] <= ends[at] + 1e-9


def test_matrix_has_exact_margins_and_the_right_spread(spark):
    n, shards, part = 24, 3, 256
    counts = spark.createDataFrame([(p, n) for p in range(part)], "part long, n long")
    got = []
    for seed in range(2):
        rows = sharding.communication_matrix(counts, shards, seed).collect()
        assert sorted(r["part"] for r in rows) == list(range(part)) and all(sum(r["sizes"]) == r["n"] for r in rows)
        assert [sum(r["sizes"][k] for r in rows) for k in range(shards)] == [2048] * 3
        got += [x for r in rows for x in r["sizes"]]
    # variance of a cell under the hypergeometric law; 1,020 free cells
    p = pmf(2048, 4096, n)
    want = sum(p[x] * (x - 8) ** 2 for x in p)
    assert 0.85 * want < sum((x - 8) ** 2 for x in got) / len(got) < 1.15 * want


def test_matrix_of_uneven_partitions(spark):
    sizes = [0, 1, 7, 1000, 3, 0, 250_000, 12]
    counts = spark.createDataFrame([(p, n) for p, n in enumerate(sizes) if n], "part long, n long")
    rows = sharding.communication_matrix(counts, 8).collect()
    assert {r["part"]: sum(r["sizes"]) for r in rows} == {p: n for p, n in enumerate(sizes) if n}
    columns = [sum(r["sizes"][k] for r in rows) for k in range(8)]
    assert sum(columns) == sum(sizes) and max(columns) - min(columns) <= 1


def check_shards(rows, n, shards):
    by = {}
    for shard, slot in rows:
        by.setdefault(shard, []).append(slot)
    assert sorted(len(by.get(k, [])) for k in range(shards)) == sorted([n // shards + (k < n % shards) for k in range(shards)])
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values()) and set(by) <= set(range(shards))


def test_shards_of_real_rows(spark, data):
    rows = duckdb.sql(f"select doc_id, coalesce(text, '') from '{data}/documents.parquet'").fetchall()
    got = queries.op12_sharding(spark, data).collect()
    want = {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == want and len(got) == len(rows)
    check_shards([(r["shard"], r["slot"]) for r in got], len(rows), 8)
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in queries.op12_sharding(spark, data).collect()} == {(r["doc_id"], r["shard"], r["slot"]) for r in got}
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)


def test_shards_of_awkward_rows(spark):
    """Nulls, equal rows, a third of them one row, long texts, clashing columns, fewer rows than shards, none."""
    rows = [(None, None) if i % 3 == 0 else (i % 50, "y" * 100_000 if i == 1 else f"t{i % 7}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("row", "key", "at", "shard", "cell", "s", "c", "__shard", "__Slot", "of", "ends")]).repartition(7)
    out = sharding.sharded(df, shards=3)
    assert [c.lower() for c in out.columns] == [c.lower() for c in df.columns if c.lower() not in sharding.NEW] + list(sharding.NEW)
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    check_shards([(r["__shard"], r["__slot"]) for r in got], 500, 3)
    few = sharding.sharded(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), shards=8).collect()
    check_shards([(r["__shard"], r["__slot"]) for r in few], 2, 8)
    assert sharding.sharded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shuffle_is_uniform(spark):
    """Where the rows of the first and of the last partition end up: no shard and no third of a shard is preferred, and their order is lost."""
    df = spark.range(1200).repartitionByRange(4, "id").withColumnRenamed("id", "doc_id")
    cells, rising, pairs = Counter(), 0, 0
    for seed in (1, 2):
        rows = sharding.sharded(df, shards=4, seed=seed).collect()
        cells.update((r["doc_id"] // 300 == 0, r["__shard"], r["__slot"] // 100) for r in rows if not 300 <= r["doc_id"] < 900)
        for k in range(4):
            ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["__slot"]) if r["__shard"] == k]
            rising += sum(a < b for a, b in zip(ids, ids[1:], strict=False))
            pairs += len(ids) - 1
    assert len(cells) == 24 and sum((n - 50) ** 2 / 50 for n in cells.values()) < 49.7  # p = 0.001 at 23 degrees, fewer as margins are fixed
    assert abs(rising - pairs / 2) < 4 * math.sqrt(pairs / 12)


def test_written_shards(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sharding.write_shards(docs, f"file://{tmp_path}/shards", shards=4)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.drop("__shard", "__slot").exceptAll(docs).count() == 0 and back.count() == docs.count()
    check_shards([(r["__shard"], r["__slot"]) for r in back.select("__shard", "__slot").collect()], docs.count(), 4)


def legal(roles):
    rest = roles[1:] if roles[:1] == "s" else roles
    return not roles or (rest != "" and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def cheapest(rows):
    """Every edit script of up to a few inserts, by its definition."""
    best = None
    texts = {"user": "u", "assistant": "a"}
    limit = 3 * len(rows)
    stack = [(0, "", "", (), 0)]
    while stack:
        cost, audit, roles, out, i = stack.pop()
        if cost > limit:
            continue
        if i == len(rows) and legal(roles):
            best = min(best or (cost, audit, out), (cost, audit, out))
        if not re.fullmatch("s?(ua)*u?", roles):  # nothing legal begins so
            continue
        for role in texts:  # insert
            if cost + 2 <= (best[0] if best else limit):
                stack.append((cost + 2, audit + "I", roles + texts[role], (*out, f"{role}:"), i))
        if i < len(rows):
            role, text, fault = rows[i]
            more = 1 if fault == "truncated" else 0
            stack.append((cost + 3, audit + "D", roles, out, i + 1))
            if fault in ("", "truncated"):
                stack.append((cost + more, audit + "K", roles + (role[:1] or "-"), (*out, f"{role}:{text}"), i + 1))
                for other in texts:
                    stack.append((cost + 2 + more, audit + "R", roles + texts[other], (*out, f"{other}:{text}"), i + 1))
    return best


def fault_of(role, text, seen):
    full = text.strip(" \t\n\x0b\x0c\r")
    if not full:
        return "blank"
    return "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else ""


def repaired(rows):
    """Of (turn, role, text) rows in order: the report's columns behind the conversation."""
    seen, told = set(), []
    for _, role, text in rows:
        told.append((role, text, fault_of(role, text, seen)))
        seen.add((role, text))
    turns = {t for t, *_ in rows if t is not None}
    cost, audit, out = cheapest(told) if rows else (0, "", ())
    faults = Counter(f for *_, f in told)
    pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], pairs, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def in_order(rows):
    clean = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(clean, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


CONVERSATION = "conv_id long, turn long, role string, text string"


def test_repair_equals_all_edit_scripts(spark):
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(119)]:
        for _ in range(rng.randint(1, 4)):
            rows.append((conv, rng.choice([None, 1, 2, 3, 9]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "No!", "cut off", "", " \t", None, "Yes.", "é?\r\n"])))
    clash = [F.lit(1).alias(c) for c in ("conv", "place", "edit", "fault", "initial", "seen", "cost")]
    got = {r["conv"]: tuple(r)[1:] for r in structure.repair_report(spark.createDataFrame(rows, CONVERSATION).select("*", *clash).repartition(5)).collect()}
    for conv in {r[0] for r in rows}:
        assert got[conv] == repaired(in_order([r[1:] for r in rows if r[0] == conv])), conv
    assert len(got) == 120


def test_repaired_turns_are_legal_and_whole(spark, data):
    rows = spark.read.parquet(f"{data}/conversations.parquet")
    made = structure.repaired_turns(structure.damaged(rows)).collect()
    by = {}
    for r in sorted(made, key=lambda r: (r["conv"], r["place"])):
        by.setdefault(r["conv"], []).append(r)
    for turns in by.values():
        assert [r["place"] for r in turns] == list(range(len(turns)))
        assert legal("".join(r["role"][:1] for r in turns if r["edit"] != "D")) and all((r["text"] is None) == (r["edit"] == "D") for r in turns)
    assert sum(r["edit"] != "I" for r in made) == structure.damaged(rows).count()


def test_repair_of_a_long_conversation_and_none(spark):
    n = 30_000
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i}.") for i in range(n)] + [(2, 0, "user", "long " * 200_000 + ".")]
    got = {r["conv"]: r for r in structure.repair_report(spark.createDataFrame(rows, CONVERSATION)).collect()}
    assert got[1]["audit"] == "K" * n and got[1]["cost"] == got[1]["gaps"] == got[1]["illegal"] == 0
    assert got[1]["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for c, _, r, t in rows if c == 1).encode()).hexdigest()
    assert got[2]["audit"] == "KI" and got[2]["cost"] == 2
    assert structure.repair_report(spark.createDataFrame([], CONVERSATION)).count() == 0


def test_damage_and_conversations_without_rows(spark, tmp_path):
    convs = [None, *range(150)]
    rows = [(c, t, r, x) for c in convs for t, r, x in ((0, "user", "A. B?"), (None, None, None))[: 1 if c and c % 2 else 2]]
    spark.createDataFrame(rows, CONVERSATION).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op13_structure(spark, str(tmp_path)).collect()}
    assert len(got) == 151
    for conv in convs:
        hurt = []
        for _, t, r, x in (row for row in rows if row[0] == conv):
            lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if t is None else t}".encode()) % 20
            r, x = r or " ", x or " "
            x = "" if lot == 1 else "".join(ch for ch in x if ch not in ".!?") if lot == 2 else x
            hurt += [(t, "user" if lot == 4 else r, x)] * (0 if lot == 0 else 2 if lot == 3 else 1)
        assert got[conv] == repaired(in_order(hurt)), conv
    assert any(g[-2] == "" for g in got.values())


def test_partitions_follow_the_size(spark, monkeypatch):
    from talkloom.llm import common

    df = spark.range(10)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = {}
    for size in (1, 1 << 30, 1 << 40, 100 << 40, 1 << 55, 1 << 63):
        monkeypatch.setattr(common, "input_bytes", lambda _, size=size: size)
        sizes[size] = common.partitions_for(df)
    assert sizes[1] == sizes[1 << 63] == least and sizes[1 << 30] == 96 and sizes[1 << 40] == 98_304
    assert sizes[100 << 40] == math.ceil(3 * (100 << 40) / (512 << 20)) and all(3 * s / n <= 512 << 20 for s, n in sizes.items() if s < 1 << 60)
    monkeypatch.undo()
    assert common.partitions_for(spark.createDataFrame([(1,)] * 50, "x int").repartition(3)) == least
