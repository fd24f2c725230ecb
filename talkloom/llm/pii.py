"""Personal data by base rules and bootstrapped contextual extraction, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talkloom.llm import spans
from talkloom.llm.common import body, cut, drop_table

# The base patterns, in the order their kinds are listed.  Lookbehind and possessive loops keep
# the leftmost matches and bound the time on long runs; \G lets a match begin where the last one ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]
PARTS_TO_255 = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
#: Words that could be identifiers: six characters or more with a digit or an at sign.
WORD = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Rounds of scoring; least instances of a pattern; least confidence of a pattern and of a discovered identifier.
ROUNDS, SUPPORT, SURE_PATTERN, SURE = 3, 5, 0.8, 0.9


def luhn(value: Column) -> Column:
    """Whether the digits pass Luhn; zeros in front change nothing."""
    digits = F.lpad(F.regexp_replace(value, "[^0-9]", ""), 19, "0")
    total = F.lit(0)
    for i in range(19):
        d = F.substring(digits, 19 - i, 1).cast("int")
        total = total + (d if i % 2 == 0 else F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return total % 10 == 0


def digit_count(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind that pass its test."""
    return {
        "email": spans.spans(text, EMAIL, context=True),
        "ip": F.filter(spans.spans(text, IP, context=True), lambda x: x["v"].rlike(PARTS_TO_255)),
        "card": F.filter(spans.spans(text, CARD, context=True), lambda x: digit_count(x["v"]).between(16, 19) & luhn(x["v"])),
        "phone": F.filter(spans.spans(text, PHONE, context=True), lambda x: digit_count(x["v"]).between(8, 15)),
    }


def graph_edges(found: DataFrame) -> DataFrame:
    """(pattern, value, kind): each mention under its three context patterns; kind is null for unknown values."""
    left, right = F.col("left"), F.col("right")
    both = F.when((left != "") & (right != ""), F.concat(F.lit("B "), left, F.lit(" "), right))
    rules = F.array_compact(F.array(F.when(left != "", F.concat(F.lit("L "), left)), F.when(right != "", F.concat(F.lit("R "), right)), both))
    return found.select(F.explode(rules).alias("pattern"), "value", "kind").distinct()


def scored_values(edges: DataFrame) -> DataFrame:
    """(value, kind, score) of the unknown values that confident patterns extract.

    Each round scores a pattern by the mean score of its distinct instances, pulled towards 0 by one
    instance, then an instance by the chance that not all its confident patterns err.  Seeds keep score 1.
    Patterns come from all instances scored so far: what a round discovers induces patterns of its own in
    the next, so identifiers are found up to ROUNDS contexts away from a seed.
    """
    unknown = edges.where("kind is null").select("pattern", "value").distinct()
    size = cut(edges.groupBy("pattern").agg(F.count_distinct("value").alias("n")).where(F.col("n") >= SUPPORT), "pii-sizes")
    seeds = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count_distinct("value").cast("double").alias("weight"))
    base = cut(seeds.join(size, "pattern").select("pattern", "kind", "n", "weight"), "pii-patterns")
    scores = None
    for step in range(ROUNDS):
        support = base
        if scores is not None:
            # rounded, so that the order of a sum moves nothing over a threshold
            met = unknown.join(scores, "value").groupBy("pattern", "kind").agg(F.round(F.sum("score"), 9).alias("weight"))
            both = base.union(met.join(size, "pattern").select("pattern", "kind", "n", "weight"))
            support = both.groupBy("pattern", "kind").agg(F.max("n").alias("n"), F.sum("weight").alias("weight"))
        sure = support.withColumn("conf", F.col("weight") / (F.col("n") + 1)).where(F.col("conf") >= SURE_PATTERN)
        err = F.sum(F.log1p(-F.col("conf")))
        new = unknown.join(sure.select("pattern", "kind", "conf"), "pattern").groupBy("value", "kind").agg(F.round(1 - F.exp(err), 9).alias("score"))
        new = cut(new, f"pii-scores-{step}")
        if scores is not None:
            drop_table(scores)
        scores = new
    for table in (size, base):
        drop_table(table)
    return scores


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base and added, both arrays of (p, s, e, kind).

    Base spans are seeds.  The words around them are lexical patterns; the graph of patterns and the
    values they surround is scored over the whole corpus, and values without a kind that confident
    patterns extract are added under the kind they score best for (the first listed on ties), unless
    they overlap a base span.  Null and empty texts have no span.  Rows that repeat an identifier and a
    text share their answer; null identifiers are rows like others.  Other columns are not looked at.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("text"))
    kinds = base_spans(text)
    loose = F.transform(
        spans.spans(text, WORD, context=True),
        lambda x: F.struct(x["s"].alias("s"), F.rtrim(x["v"], F.lit(".,;:!?)\"'")).alias("v"), x["left"].alias("left"), x["right"].alias("right")),
    )
    slim = cut(rows.select("doc_id", F.xxhash64("text").alias("mark"), *[v.alias(k) for k, v in kinds.items()], loose.alias("loose")), "pii-slim")
    base = F.concat(*[spans.tagged(F.col(k), k, i) for i, k in enumerate(KINDS)])
    ended = F.transform("loose", lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.length(x["v"])).alias("e"), x["v"].alias("v"), x["left"].alias("left"), x["right"].alias("right")))
    slim = slim.select("doc_id", "mark", *KINDS, base.alias("base"), ended.alias("ended"))
    free = F.filter("ended", lambda x: (F.length(x["v"]) >= 6) & F.forall("base", lambda b: spans.apart(x, b)))
    slim = slim.withColumn("free", free)
    known = [slim.select(F.explode(k).alias("x")).select(F.lower("x.v").alias("value"), F.lit(k).alias("kind"), "x.left", "x.right") for k in KINDS]
    loose_rows = slim.where(F.size("free") > 0).select("doc_id", "mark", F.explode("free").alias("x"))
    unknown = loose_rows.select(F.lower("x.v").alias("value"), F.lit(None).cast("string").alias("kind"), "x.left", "x.right")
    mentions = known[0].union(known[1]).union(known[2]).union(known[3]).union(unknown)
    scores = scored_values(cut(graph_edges(mentions), "pii-edges"))
    rank = F.map_from_arrays(F.array(*[F.lit(k) for k in KINDS]), F.array(*[F.lit(-i) for i in range(4)]))
    best = scores.where(F.col("score") >= SURE).groupBy("value").agg(F.max_by("kind", F.struct("score", F.element_at(rank, F.col("kind")))).alias("kind"))
    place = F.map_from_arrays(F.array(*[F.lit(k) for k in KINDS]), F.array(*[F.lit(i) for i in range(4)]))
    one = loose_rows.select("doc_id", "mark", F.lower("x.v").alias("value"), "x.s", "x.e").join(best, "value")
    new = F.collect_set(F.struct(F.element_at(place, F.col("kind")).alias("p"), "s", "e", "kind")).alias("new")
    added = one.groupBy("doc_id", "mark").agg(new).select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "new")
    none = F.array().cast("array<struct<p:int,s:int,e:int,kind:string>>")
    out = slim.join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    return out.select("doc_id", "base", F.coalesce("new", none).alias("added"))


def personal_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return personal_data(docs, **options).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(spans.joined(F.col("base"), False), 256).alias("base_sha256"),
        spans.joined(F.concat("base", "added"), False).alias("spans"),
    )
