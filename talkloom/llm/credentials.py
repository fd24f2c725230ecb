"""Secret scans with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talkloom.llm import spans
from talkloom.llm.common import body, cut

# The base patterns.  HEX and ACCESS spell their least lengths, which the base rule applies afterwards.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
KINDS = ["assign", "access", "hex"]
#: Parts that are reported only together: identifiers, short or unlabelled secrets, endpoints.
PARTS = {
    "id": r"""(?<![A-Za-z0-9])(?i:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?|key_?id)["']?[\x20\t]{0,8}[:=][\x20\t]{0,8}["']?[A-Za-z0-9@._+-]{3,}+""",
    "key": r"""(?<![A-Za-z0-9])(?i:pass|pwd|password|passwd|secret|token|auth|credentials?|private_?key|api_?key|secret_?key)["']?[\x20\t]{0,8}[:=][\x20\t]{0,8}["']?[^\s"',;]{4,}+""",
    "endpoint": r"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>]{3,}+""",
}
#: Parts further apart than so many code points are of different scopes.
SCOPE = 200


def parts_of(text: Column) -> Column:
    """Weak candidates (start, end, class)."""

    def of(name: str, rule: str) -> Column:
        return F.transform(spans.spans(text, rule), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(name).alias("c")))

    return F.concat(*[of(name, rule) for name, rule in PARTS.items()])


def linked_parts(weak: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, parts) of the candidates that have a part of another class, one of the two a secret, in scope.

    Interval join: a candidate lies in each block of SCOPE code points it touches once widened by SCOPE,
    so two parts in scope meet in some block; the exact distance is checked afterwards.
    """
    one = weak.select("doc_id", "mark", F.explode(F.array_distinct("weak")).alias("w")).select("doc_id", "mark", "w.*")
    wide = one.withColumn("block", F.explode(F.sequence(F.floor((F.col("s") - SCOPE) / SCOPE), F.floor((F.col("e") + SCOPE) / SCOPE))))
    there = one.withColumn("block2", F.floor(F.col("s") / SCOPE)).select(*[F.col(c).alias(f"{c}_o") for c in ("doc_id", "mark", "s", "e", "c")], "block2")
    # the smaller side of a pair is found from either end: each candidate looks for partners that start in its blocks
    same = F.col("doc_id").eqNullSafe(F.col("doc_id_o")) & (F.col("mark") == F.col("mark_o")) & (F.col("block") == F.col("block2"))
    close = (F.col("s_o") - F.col("e") <= SCOPE) & (F.col("s") - F.col("e_o") <= SCOPE)
    other = (F.col("c") != F.col("c_o")) & ((F.col("c") == "key") | (F.col("c_o") == "key"))
    met = wide.join(there, same & close & other)
    both = met.select("doc_id", "mark", "s", "e", "c").union(met.select("doc_id", "mark", "s_o", "e_o", "c_o")).distinct()
    return both.groupBy("doc_id", "mark").agg(F.collect_list(F.struct(F.lit(len(KINDS)).alias("p"), "s", "e", F.col("c").alias("kind"))).alias("parts"))


def secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base and parts, both arrays of (p, s, e, kind).

    Base spans are always reported.  Parts are identifiers, secrets and endpoints that the base rules are
    too strict for; they count only if complementary ones stand within SCOPE code points, and not where
    they overlap a base span.  Null and empty texts have none.  Rows that repeat an identifier and a text
    share their answer; null identifiers are rows like others.  Other columns are not looked at.
    """
    text = F.col("text")
    long_enough = F.filter(spans.spans(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["v"], ASSIGN, 1)) >= 12)
    found = [long_enough, spans.spans(text, ACCESS), spans.spans(text, HEX)]
    base = F.concat(*[spans.tagged(f, k, i) for i, (k, f) in enumerate(zip(KINDS, found, strict=True))])
    rows = docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("text"))
    slim = cut(rows.select("doc_id", F.xxhash64("text").alias("mark"), base.alias("base"), parts_of(text).alias("weak")), "secrets-slim")
    free = F.filter("weak", lambda w: F.forall("base", lambda b: spans.apart(w, b)))
    # base secrets and access identifiers are parts too; overlapping weak ones add nothing
    strong = F.transform(F.filter("base", lambda b: b["kind"] != "hex"), lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), F.when(b["kind"] == "access", "id").otherwise("key").alias("c")))
    several = slim.where(F.size("weak") + F.size("base") > 1).select("doc_id", "mark", F.concat(free, strong).alias("weak"))
    parts = linked_parts(several.where(F.size(F.array_distinct(F.transform("weak", lambda w: w["c"]))) > 1))
    parts = parts.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "parts")
    joined = slim.join(parts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    none = F.array().cast("array<struct<p:int,s:int,e:int,kind:string>>")
    added = F.filter(F.coalesce("parts", none), lambda w: F.forall("base", lambda b: spans.apart(w, b)))
    return joined.select("doc_id", "base", added.alias("parts"))


def secrets_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return secrets(docs, **options).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(spans.joined(F.col("base"), True), 256).alias("base_sha256"),
        spans.joined(F.concat("base", "parts"), True).alias("spans"),
    )
