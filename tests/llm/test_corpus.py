"""The corpus operators against brute force, on real rows and on awkward ones."""

import importlib
import pathlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.test_queries import compare
from talkloom.llm import common, credentials, decontamination, exact, mixing, near, paragraphs, pii, quality, queries, shingles, suffixes, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is was for on with that this as at by from or an be are Über café naïve ñandú 北京 data text model line".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(3)
    base = prose(rng, 300)
    edited = base.split(" ")
    edited[150] = "changed"
    passage = prose(rng, 120)
    texts = [None, "", " \t\n", "one", "one two three four", base, base, " ".join(edited), prose(rng, 40) + " " + passage + " " + prose(rng, 30), prose(rng, 60) + " " + passage, "x" * 900, prose(rng, 30_000)]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    rows += [(5, base, "en", "s1", 1), (None, "nobody's words are here today", None, None, None)]
    clash = ["size", "score", "key", "root", "node", "block", "region", "__x", "keep_id", "component_id", "__size", "__copies", "__score", "___score", "__n_hit", "__items", "mark", "kept_id", "row", "doc", "copy", "class", "hash"]
    df = spark.createDataFrame(rows, SCHEMA)
    return rows, df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)]).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def small(data, n=200):
    return duckdb.sql(f"select doc_id, text from '{data}/documents.parquet' order by 1 limit {n}").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, data, name):
    compare(spark, data, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_all_survive_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for made in (
        exact.exact_groups(empty), mixing.mix(empty), near.near_report(empty), decontamination.contamination_report(empty, items), quality.quality_report(empty, labels), suffixes.repeated_bytes(empty),
        pii.personal_report(empty), credentials.secrets_report(empty), paragraphs.repeated_paragraphs(empty), mixing.mixed_documents(empty), near.near_deduplicated(empty),
    ):
        assert made.count() == 0


def test_tokens_round_trip(spark, awkward, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rows, df = awkward
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    tokens.write_tokens(df, f"file://{tmp_path}/t", path)
    got = tokens.read_tokens(spark, f"file://{tmp_path}/t").collect()
    want = sorted(((i is not None, i or 0, whole.encode(t or "", add_special_tokens=False).ids + [2], i) for i, t, *_ in rows), key=lambda x: x[:3])
    got = sorted(got, key=lambda r: r["start"])
    ranks = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert ranks == sorted(ranks) and sorted((*k, r["ids"], r["doc_id"]) for k, r in zip(ranks, got, strict=True)) == want
    start = 0
    for r in got:
        raw = b"".join(i.to_bytes(4, "little") for i in r["ids"])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(r["ids"]), zlib.crc32(raw))
        start += r["n_tokens"]
    one = tokens.read_tokens(spark, f"file://{tmp_path}/t", ids=[7]).collect()
    assert [(r["doc_id"], r["start"]) for r in one] == [(r["doc_id"], r["start"]) for r in got if r["doc_id"] == 7]


def test_encoder_equals_library(data):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    codes = tokens.Encoder(path)
    rng = random.Random(1)
    alphabet = list("abcXYZ019'\"<|>.,!$ \n\t\r  éÉßÿŸıİſŉÀÖØöøĀſ́̈ΣσςǅȺ中😀") + ["<|endoftext|>", "'s", "'RE", "i̇", " ", " ", "\x1c", "\x1f", "\x85", "\xa0", "\u2000", "\u2028", "\u3000", "\x0b", "\x0c", "naïve", "ÜBER"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [t for _, t in small(data)]
    for t in texts:
        assert codes.text(t) == codes.packed(codes.whole.encode(t, add_special_tokens=False).ids), repr(t)


def test_exact_and_ties(awkward):
    rows, df = awkward
    for keep, best in (("largest", max), ("smallest", min)):
        got = exact.exact_groups(df, keep=keep).collect()
        assert len(got) == len(rows)
        groups = {}
        for i, t, *_ in rows:
            groups.setdefault(t or "", []).append(i)
        for r in got:
            ids = next(g for t, g in groups.items() if brute.sha(t) == r["text_sha256"])
            known = [i for i in ids if i is not None]
            assert (r["keep_id"], r["group_size"]) == (best(known) if known else None, len(ids)) and r["kept"] == (r["doc_id"] == r["keep_id"])


def test_exact_hot_and_common_contents(spark):
    """A third of the rows one text, another common one, pairs, and texts that differ behind their heads only."""
    hot, other = "h" * 300, "h" * 299 + "i"
    texts = [hot if i % 3 == 0 else other if i % 7 == 0 else f"{'p' * 50}{i // 2}" for i in range(20_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in exact.exact_groups(df).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t, []).append(i)
    assert len(got) == len(texts)
    for t, ids in groups.items():
        assert all((got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (ids[0], len(ids), i == ids[0], brute.sha(t)) for i in ids)
    marked = df.select("doc_id", F.encode("text", "UTF-8").alias("content")).withColumn("mark", F.xxhash64("content"))
    assert 2 <= exact.hot_contents(marked, len(texts), 40).count() <= 160


def test_mixing_targets_and_copies(spark, data, awkward):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for df in (docs, awkward[1]):
        mixed = mixing.mix(df).collect()
        assert len(mixed) == df.count()
        sizes = {}
        for r in mixed:
            sizes[r["source"]] = sizes.get(r["source"], 0) + r["__size"]
        aims = brute.targets(sizes)
        for r in mixed:
            assert r["__source_size"] == sizes[r["source"]] and abs(r["__target"] - aims[r["source"]]) < 1e-6 * max(1, aims[r["source"]]) and 0 <= r["__copies"] <= 2
    again = {r["doc_id"]: r["__copies"] for r in mixing.mix(docs.repartition(7)).collect()}
    first = mixing.mix(docs).collect()
    assert again == {r["doc_id"]: r["__copies"] for r in first}
    for s in {r["source"] for r in first}:
        mine = [r for r in first if r["source"] == s]
        taken, longest = sum(r["__copies"] * r["__size"] for r in mine), max(r["__size"] for r in mine)
        assert abs(taken - mine[0]["__target"]) <= longest
    assert mixing.mixed_documents(docs).count() == sum(r["__copies"] for r in first)
    odd = mixing.mixed_documents(awkward[1])
    assert odd.columns == awkward[1].columns and {r["__size"] for r in odd.collect()} == {10}


def test_mixing_sums_fit(spark):
    rows = 10**12
    got = spark.sql(f"select {rows}L as p, {2 * mixing.UNIT}L as e, {mixing.UNIT - 1}L as o").select(mixing.crossings(F.col("p"), F.col("e"), F.col("o")).alias("n")).first()
    assert got["n"] == 2


def test_decontamination_on_awkward_rows(spark, awkward):
    rows, df = awkward
    long = rows[8][1].split(" ")[45:70]
    items = [(1, " ".join(long)), (2, "ONE two"), (3, None), (4, "!!"), (2, "one, TWO"), (5, "nobody"), (None, "words are"), (10, "北京")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute.windows([(i, t) for i, t, *_ in rows], [x for x in items if x[0] is not None])
    for size in (1 << 20, 5):  # one block of items, and many
        got = decontamination.contamination_report(df, bench.where("item_id is not null"), item_bytes=size).collect()
        assert {r["doc_id"]: tuple(r)[1:] for r in got} == expected and len(got) == len(rows)
    left = decontamination.decontaminated(df, bench.where("item_id is not null"), item_bytes=5)
    assert left.columns == df.columns and sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(i) for i, *_ in rows if not expected[i][-1])


def test_decontamination_leaves_one_copy(spark):
    """Six blocks of items: the copy that the result reads stays, those between are gone."""
    docs = spark.createDataFrame([(i, f"alpha{i} beta gamma") for i in range(20)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"alpha{3 * i} beta") for i in range(6)], "item_id long, text string")
    folder = pathlib.Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(folder.glob("contamination-*"))
    got = decontamination.contamination_report(docs, bench, item_bytes=1).collect()
    assert {r["doc_id"] for r in got if r["contaminated"]} == set(range(0, 18, 3)) and len(got) == 20
    assert len(set(folder.glob("contamination-*")) - before) == 1


def test_decontamination_tables_are_bounded():
    rng = random.Random(2)
    texts = [prose(rng, 300) for _ in range(300)]
    made = decontamination.tables(texts)
    words = made[0].words
    assert sum(t.nbytes() for t in made) + sum(x.nbytes for x in vars(words).values()) <= 12 * sum(len(t.encode()) for t in texts)


def test_near_matches_brute_force(spark, data, awkward):
    real = small(data)
    df = spark.createDataFrame(real, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near.near_report(df).collect()} == brute.near(real)
    rows, odd = awkward
    want = brute.near([(i, t) for i, t, *_ in rows if i is not None])
    got = near.near_report(odd).collect()
    assert len(got) == len(rows) and {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None} == want
    left = near.near_deduplicated(odd)
    assert left.columns == odd.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == sorted(i for i, (_, _, kept) in want.items() if kept)


def test_near_joins_a_dense_group(spark):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 500)}" for _ in range(400)]
    rows = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(400)] = f"e{i}"
        words[rng.randrange(400)] = f"f{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"z{rng.randint(0, 9999)}" for _ in range(100))) for i in range(50)]
    got = near.near_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["component_id"] == (0 if r["doc_id"] < 1000 else r["doc_id"]) for r in got)


def twins(rng, n, same, own, common):
    """2 n texts of which all share `same` words and two each `common` of `own` further words."""
    start, words = [f"b{rng.randint(0, 9999)}" for _ in range(same)], lambda k: [f"u{rng.randint(0, 1 << 40)}" for _ in range(k)]
    rows = []
    for i in range(n):
        both = words(common)
        rows += [(2 * i + j, " ".join(start + both + words(own - common))) for j in range(2)]
    return rows


def test_near_links_twins_in_a_dense_region(spark):
    rows = twins(random.Random(3), 2500, 76, 14, 3)  # 0.77 to the twin, 0.72 to all others
    got = near.near_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows) and all(r["component_id"] == r["doc_id"] // 2 * 2 for r in got)


def test_sharing_misses_no_link(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint64) for _ in range(300)]
    rows = [(i.to_bytes(2, "big"), i % 7, bytearray(v.tobytes())) for i, v in enumerate(sets)]
    pairs = shingles.sharing(spark.createDataFrame(rows, "key binary, part long, values binary"), common.cut).collect()
    met = {tuple(sorted((int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big")))) for r in pairs}
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if i % 7 != j % 7 and shingles.alike(sets[i].tobytes(), sets[j].tobytes())}
    assert want and want <= met and all(i % 7 != j % 7 for i, j in met)


def test_quality_held_out(spark, data):
    docs, labels = spark.read.parquet(f"{data}/../sf0.01/documents.parquet"), spark.read.parquet(f"{data}/../sf0.01/labels.parquet")
    got = quality.quality_report(docs, labels)
    joined = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in joined) >= 0.97 * len(joined)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got.collect())
    # labels of the held-out third change nothing
    flipped = labels.withColumn("quality", F.when(quality.remainder() == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r["doc_id"]: r["score"] for r in quality.quality_report(docs, flipped).collect()} == {r["doc_id"]: r["score"] for r in got.collect()}


def test_quality_field_matches_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    field = quality.Field(rng.normal(size=3), rng.normal(size=(2, 2)), np.zeros(3), np.ones(3))
    x, lengths = rng.normal(size=(9, 3)), np.array([4, 1, 3, 1])
    got, pairs = field.marginals(x, lengths)
    at, total = 0, np.zeros((2, 2))
    for n in lengths:
        z, good, move = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            s = sum(x[at + i] @ field.weights for i in range(n) if path[i]) + sum(field.moves[a, b] for a, b in itertools.pairwise(path))
            p = np.exp(s)
            z += p
            good += p * np.array(path)
            for a, b in itertools.pairwise(path):
                move[a, b] += p
        assert np.allclose(got[at : at + n], good / z)
        total += move / z
        at += n
    assert np.allclose(pairs, total)


def test_quality_awkward(spark, awkward):
    rows, df = awkward
    labels = spark.createDataFrame([(5, 1), (7, 1), (None, 0), (9, None), (10, 0), (10, 0), (11, 0)], "doc_id long, quality int")
    got = quality.quality_report(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.good_documents(df, labels).columns == df.columns


def test_tied_windows_are_told_apart_by_a_second_kind_of_hash():
    rng = np.random.default_rng(9)
    window = rng.integers(0, 256, suffixes.LENGTH, dtype=np.uint8)
    swapped = window.copy()
    swapped[[3, 131]] = swapped[[131, 3]]  # what low bits of sums of odd products do not tell
    at = np.array([7, 900, suffixes.SEGMENT - 100, suffixes.SEGMENT + 5_000])
    data = rng.integers(0, 256, suffixes.SEGMENT + 9_000, dtype=np.uint8)
    for place, what in zip(at, (window, swapped, window, window), strict=True):
        data[place : place + suffixes.LENGTH] = what
    keys = suffixes.sure_keys(data, at, np.full(len(at), 5, np.uint64))  # as if the first hash were equal for all
    assert keys[0] == keys[2] == keys[3] != keys[1]
    assert len(set(suffixes.sure_keys(data, at, np.arange(4, dtype=np.uint64)).tolist())) == 4
    many = np.sort(rng.choice(len(data) - suffixes.LENGTH, 50_000, replace=False))
    same = suffixes.sure_keys(data, many, np.zeros(len(many), np.uint64))
    assert len(np.unique(same)) >= len(many) - 2 * suffixes.LENGTH  # only windows over the planted copies may agree


def test_keys_without_a_second_one_are_false_ties(spark):
    values = [np.array([5 << 32 | 7, 9 << 32 | 8], np.uint64), np.array([5 << 32 | 7, 3 << 32 | 8, 3 << 32 | 8], np.uint64)]
    rows = [tuple(r.values()) for block, v in enumerate(values) for r in suffixes.fragments(block, [v], 4, half=True).to_pylist()]
    found = {(r["block"], v) for r in suffixes.repeated(spark.createDataFrame(rows, suffixes.FRAGMENT), half=True).collect() for v in np.frombuffer(r["keys"], np.uint64).tolist()}
    assert found == {(0, int(suffixes.coded(values[0][1:], 4)[0]))}  # 5 occurs in both blocks, 3 twice in one


def test_suffixes_match_brute_force(spark, awkward, data):
    rows = [(i, t) for i, t, *_ in awkward[0] if not t or len(t) < 20_000] + [(100 + i, t) for i, t in small(data, 60)]
    rows += [(301, "ab" * 300), (302, "x" * 399), (303, "y" * 400), (304, "z" * 401)]
    got = suffixes.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r)[1:5] for r in got) == sorted(x[1:] for x in brute.suffixes(rows))
    assert {r["doc_id"]: tuple(r)[1:5] for r in got if r["doc_id"] != 5} == {x[0]: x[1:] for x in brute.suffixes(rows) if x[0] != 5}


def test_planted_passages_go_from_400_bytes_on(spark, tmp_path):
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))
    passages = [text(n) for n in range(51, 91)] + [text(90)[:n] for n in (398, 399, 400, 401)]
    rows, want = [], {}
    for passage in passages:
        for side in "AB":  # neighbours differ, so a pair shares the passage and no byte more
            before, after = text(rng.randint(5, 120)) + side, side + text(rng.randint(5, 120))
            gone = len(passage) >= 400
            rows.append((len(rows), before + passage + after))
            want[rows[-1][0]] = (len(rows[-1][1]), len(passage) * gone, int(gone), brute.sha(before + after if gone else rows[-1][1]))
        rows.append((len(rows), text(200)))  # a clean row
        want[rows[-1][0]] = (len(rows[-1][1]), 0, 0, brute.sha(rows[-1][1]))
    assert all(len(p.split()) > 50 for p in passages) and 10 < sum(len(p) >= 400 for p in passages) < len(passages) - 10
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_suffixes(spark, str(tmp_path))
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {r["doc_id"]: tuple(r)[1:5] for r in got.collect()} == want


def test_difference_cover():
    cover = suffixes.COVER
    assert {(a - b) % suffixes.PERIOD for a in cover for b in cover} == set(range(suffixes.PERIOD)) and len(cover) == suffixes.ORDER + 1


FRAGMENTS = ["a@b.c", "x@y", "john.doe@mail.example.com", "_d@e.f", "1.2.3.4", "256.1.1.1", "001.2.3.04.5.6.7.8", "+1 (234) 555-1234", "+49 30 1234567 ", "4111 1111 1111 1111", "4111-1111-1111-1111 2", " ", "\n", "é", "😀", "ñ@z.de",
             'token = "abc"', 'TOKEN:"abcdefghijklmnop"', "api_key=secret=ABCDEFGHIJKLMNOP", "passwd : 'xx", "AKIA1234567890ABCD", "AKIAAKIA", "deadbeefdeadbeef", "0123456789abcdef0", ".", "-", "@", "+", "9", "a" * 5, "0" * 30, "%"]


@pytest.fixture(scope="module")
def fragments(spark, data):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 25)))) for i in range(600)] + [(5000, None), (5001, "a" * 200_000 + "@"), (5002, "1 " * 50_000), (5003, "f" * 100_000)]
    rows += [(10_000 + i, t) for i, t in small(data)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_pii_base(fragments):
    rows, df = fragments
    texts = dict(rows)
    for r in pii.personal_report(df).collect():
        want = brute.pii(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == brute.sha(brute.joined(want)), texts[r["doc_id"]][:200]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert set(brute.joined(want).split(",")) <= set(r["spans"].split(","))


def test_pii_discovers_by_context(spark):
    rng = random.Random(2)
    rows = [(i, f"{prose(rng, 5)} reach-me-at: user{i}@mail.example.com thanks {prose(rng, 5)}") for i in range(60)]
    rows += [(100 + i, f"{prose(rng, 5)} reach-me-at: user{i}(at)mail9 thanks {prose(rng, 5)}") for i in range(3)]
    rows += [(200 + i, prose(rng, 30)) for i in range(30)]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for i in range(3):
        kind, s, e = got[100 + i].split(":")
        assert kind == "email" and texts[100 + i][int(s) : int(e)] == f"user{i}(at)mail9"
    assert all(not got[200 + i] for i in range(30))


def test_pii_discoveries_induce_patterns(spark):
    """Seeds under one context, unknown values under it and under a second one, which holds two values more."""
    rng = random.Random(5)
    shown = lambda i: f"id{i}(at)mail{i}"
    rows = [(i, f"{prose(rng, 4)} reach-me-at: user{i}@mail.example.com thanks {prose(rng, 4)}") for i in range(400)]
    rows += [(1000 + i, f"{prose(rng, 4)} reach-me-at: {shown(i)} thanks {prose(rng, 4)}") for i in range(60)]
    rows += [(2000 + i, f"{prose(rng, 4)} mailbox-of-mine {shown(i)} goodbye {prose(rng, 4)}") for i in range(62)]
    rows += [(3000 + i, prose(rng, 30)) for i in range(60)]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        want = [] if i >= 3000 else [w for w in t.split() if "mail" in w and ("@" in w or "(at)" in w)]
        assert [t[int(x.split(":")[1]) : int(x.split(":")[2])] for x in got[i].split(",") if x] == want, t


def test_pii_scores_equal_brute_force(spark):
    rng = random.Random(6)
    kinds = {f"v{i}": rng.choice(["email", "phone"]) for i in range(300) if i % 8}
    edges = set()
    for p in range(60):
        kind = rng.choice(["email", "phone"])
        fit = [f"v{i}" for i in range(300) if kinds.get(f"v{i}", kind) == kind or rng.random() < 0.02]
        # every third pattern knows few seeds, so only discoveries can make it sure
        like = rng.sample([v for v in fit if v not in kinds] if p % 3 == 0 else fit, rng.randint(4, 30))
        edges |= {(f"p{p}", v, kinds.get(v)) for v in like}
    edges |= {("p0", "v1", kinds["v1"])}
    got = {(r["value"], r["kind"]): r["score"] for r in pii.scored_values(spark.createDataFrame(sorted(edges, key=repr), "pattern string, value string, kind string")).collect()}
    want = brute.scored_values(edges)
    assert set(got) == set(want) and len(want) > 10 and all(abs(got[x] - want[x]) < 1e-6 for x in want)


def test_secrets_base_and_linking(fragments, spark):
    rows, df = fragments
    texts = dict(rows)
    for r in credentials.secrets_report(df).collect():
        want = brute.secrets(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == brute.sha(brute.joined(want)), texts[r["doc_id"]][:200]
        assert set(brute.joined(want).split(",")) <= set(r["spans"].split(","))
    far = "x " * 200
    cases = [(1, "user: bob pwd: hunter2"), (2, "user: bob and nothing else"), (3, "pwd: hunter2"), (4, f"user: bob {far} pwd: hunter2"), (5, "https://db.example.com/x and pass=abcd"), (6, None), (1, "user: bob pwd: hunter2")]
    got = credentials.secrets_report(spark.createDataFrame(cases, "doc_id long, text string")).collect()
    kinds = {r["doc_id"]: sorted(s.split(":")[0] for s in r["spans"].split(",") if s) for r in got}
    assert len(got) == 7 and kinds == {1: ["id", "key"], 2: [], 3: [], 4: [], 5: ["endpoint", "key"], 6: []}


def test_secrets_whole_values(spark):
    url, token, name = "https://h.example.com/" + "z" * 700, "x9" * 400, "n" * 300
    rows = [(1, f"{url} pwd=hunter2"), (2, f"user: bob auth={token}"), (3, f"login={name} pass: abcd")]
    got = {r["doc_id"]: r["spans"] for r in credentials.secrets_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: f"endpoint:0:{len(url)},key:{len(url) + 1}:{len(url) + 12}", 2: f"id:0:9,key:10:{15 + len(token)}", 3: f"id:0:{6 + len(name)},key:{7 + len(name)}:{17 + len(name)}"}


def test_paragraphs_find_passages(spark, awkward):
    rng = random.Random(8)
    passage = ". ".join(prose(rng, 14) for _ in range(8)) + "."
    rows = [(i, prose(rng, 80) + " " + passage + " " + prose(rng, 70)) for i in range(12)] + [(100 + i, prose(rng, 150)) for i in range(20)] + [(200, prose(rng, 5)), (201, None)]
    got = {r["doc_id"]: r for r in paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["n_removed"] == 0 and got[0]["n_repeated"] > 0
    texts = dict(rows)
    for i in range(1, 12):
        cut = b"".join(texts[i].encode()[s["s"] : s["e"]] for s in got[i]["spans"]).decode()
        assert got[i]["sources"] == [0] and len(cut) > 0.6 * len(passage) and cut[20:-20] in passage
    assert all(got[100 + i]["n_repeated"] == 0 for i in range(20)) and got[201]["n_paragraphs"] == 0
    assert paragraphs.repeated_paragraphs(awkward[1]).count() == len(awkward[0])


def test_paragraphs_hold_every_word():
    import pyarrow as pa

    rng = random.Random(4)
    texts = ["", "one", " "]
    for often in (0, 0.05, 1):
        for n in (15, 16, 65, 400):
            for words in ([f"w{rng.randint(0, 9999)}" for _ in range(n)], ["same"] * n):
                texts += [rng.choice(["", " "]) + " ".join(w + ("." if rng.random() < often else "") for w in words) + rng.choice(["", "\n"])]
    both = next(shingles.text_groups(pa.array(texts), 1 << 30))
    first, last = paragraphs.paragraphs_in(both)
    spans = set()
    for i, text in enumerate(texts):
        alone = paragraphs.Paragraphs(shingles.of_text(text), shingles.MinHash(12))
        n = len(text.split())
        assert {k for a, b in zip(alone.first, alone.last, strict=True) for k in range(a, b)} == set(range(n if n >= 16 else 0))
        assert all(paragraphs.MIN_WORDS <= b - a <= paragraphs.MAX_WORDS for a, b in zip(alone.first, alone.last, strict=True))
        assert all(text.encode()[a:b].split() == text.encode().split()[i:j] for a, b, i, j in zip(*alone.spans(), alone.first, alone.last, strict=True))
        spans |= {(a + both.per[i], b + both.per[i]) for a, b in zip(alone.first, alone.last, strict=True)}
    # a text's paragraphs do not depend on the texts it is grouped with
    assert spans == set(zip(first.tolist(), last.tolist(), strict=True))


def test_paragraphs_find_passages_without_sentences(spark):
    rng = random.Random(12)
    plain = lambda n: " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 9999)}" for _ in range(n))
    passages = [plain(55) for _ in range(20)]
    rows = [(100 * k + i, f"{plain(80 + 7 * i)} {passage} {plain(70)}") for k, passage in enumerate(passages) for i in range(2)]
    got = {r["doc_id"]: r for r in paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 * k]["n_removed"] == 0 and got[100 * k + 1]["sources"] == [100 * k] for k in range(20))


def test_paragraphs_link_twins_in_a_dense_band(spark):
    rows = twins(random.Random(5), 400, 25, 6, 3)  # 0.8 to the twin, 0.64 to all others
    got = {r["doc_id"]: r for r in paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[2 * i]["n_removed"] == 0 and got[2 * i + 1]["sources"] == [2 * i] for i in range(400))


def test_paragraphs_repeated_in_one_text(spark):
    rng = random.Random(6)
    passage = ". ".join(prose(rng, 14) for _ in range(5)) + "."
    text = f"{prose(rng, 80)}. {passage} {prose(rng, 60)}. {passage} {prose(rng, 60)}"
    rows = [(1, text), (2, prose(rng, 300))]
    got = {r["doc_id"]: r for r in paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    second = len(text[: text.rindex(passage)].encode())
    assert got[1]["n_removed"] > 0 and got[1]["sources"] == [] and got[2]["n_repeated"] == 0
    assert got[1]["removed_bytes"] > 0.6 * len(passage.encode()) and all(x["s"] >= second - 20 for x in got[1]["spans"])


def test_components(spark):
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(120)]
    extra = [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)]
    edges = [(a.to_bytes(4, "big"), b.to_bytes(4, "big")) for a, b in chain + extra + [(500, 500)]] + [(None, b"x")]
    got = common.components(spark.createDataFrame(edges, "a binary, b binary")).collect()
    ids = {x for e in chain + extra if e[0] != e[1] for x in e}
    want = brute.components(ids, [e for e in chain + extra if e[0] != e[1]])
    assert {int.from_bytes(r["node"], "big"): int.from_bytes(r["root"], "big") for r in got} == want


def test_components_extended(spark):
    rng = random.Random(11)
    old, new = ([(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(n)] for n in (80, 40))
    frame = lambda edges: spark.createDataFrame([(a.to_bytes(4, "big"), b.to_bytes(4, "big")) for a, b in edges], "a binary, b binary")
    got = common.extended(common.components(frame(old)), frame(new), common.cut).collect()
    edges = [e for e in old + new if e[0] != e[1]]
    want = brute.components({x for e in edges for x in e}, edges)
    assert len(got) == len(want) and {int.from_bytes(r["node"], "big"): int.from_bytes(r["root"], "big") for r in got} == want
    none = common.extended(common.components(spark.createDataFrame([], "a binary, b binary")), spark.createDataFrame([], "a binary, b binary"), common.cut)
    assert none.count() == 0


def test_shingles_as_defined():
    for text in ("", " ", "a", "A b\tC d", "a b c d e f a b c d e", "É é x"):
        assert len(shingles.shingle_set(text)) == len(brute.shingles(text))


def test_pipeline_stages(spark, data):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, known = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    items = spark.read.parquet(f"{data}/benchmark.parquet").collect()
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        docs = common.cut(stage(spark, docs, data), "stage")
        if stage is pipeline.token_stage:
            assert docs.count() == taken and docs.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == docs.agg(F.sum("n_tokens")).first()[0]
            break
        assert docs.columns == columns
        left = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert all(known[i] == t for i, t in left.items()) and set(left) <= set(before)
        if stage is pipeline.near_stage:
            assert set(left) == {i for i, (_, _, kept) in brute.near(list(before.items())).items() if kept}
        if stage is pipeline.decontamination_stage:
            hits = brute.windows(list(before.items()), [(r["item_id"], r["text"]) for r in items])
            assert set(left) == {i for i, h in hits.items() if not h[-1]}
        taken = docs.count()
