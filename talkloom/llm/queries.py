"""The registered queries of the corpus operators and the SQL they are checked against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from talkloom.llm import credentials, decontamination, exact, merkle, mixing, near, paragraphs, pii, quality, sharding, structure, suffixes, tokens
from talkloom.llm.common import body, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read_tokens(spark, path, with_ids=False)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_report(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.secrets_report(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("words"))
    mixed = mixing.mix(docs, size=F.col("words"))
    return mixed.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__copies") * F.col("__size")).alias("taken"),
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_report(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(table(spark, sf_dir, "documents")).drop("spans")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op10_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraphs.repeated_paragraphs(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["s"], x["e"])), ",")
    return found.withColumn("spans", spans)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; a seventh of them is checked as if n_chars had been one more."""
    docs = table(spark, sf_dir, "documents")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    fields = [more if f == "n_chars" else F.col(f) for f in merkle.FIELDS]
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    made = merkle.manifest(docs, carry={"tampered": F.when(tampered, merkle.leaf_of(*fields))})
    start = F.coalesce("tampered", "leaf")
    return made.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), merkle.folded(start, F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards by the law `rows`: equal texts are not kept together, each row is dealt by itself."""
    dealt = sharding.sharded(table(spark, sf_dir, "documents"), shards=8)
    text = F.encode(body(), "UTF-8")
    return dealt.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("__shard").cast("int").alias("shard"), F.col("__slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op13_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after damage, repaired; those without rows after it have zeros and empty strings."""
    rows = table(spark, sf_dir, "conversations")
    made = structure.repair_report(structure.damaged(rows))
    known = rows.select("conv_id").distinct().join(made, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return known.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {
    "op1_tokens": op1_tokens, "op2_pii": op2_pii, "op4_decontamination": op4_decontamination, "op3_mixing": op3_mixing, "op5_near_dedup": op5_near_dedup,
    "op6_quality": op6_quality, "op7_suffixes": op7_suffixes, "op8_exact_dedup": op8_exact_dedup, "op9_secrets": op9_secrets, "op10_paragraphs": op10_paragraphs,
    "op11_manifest": op11_manifest, "op12_sharding": op12_sharding, "op13_structure": op13_structure,
}

FOLD_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = f"regexp_extract_all({FOLD_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def crc_sql(text: str) -> str:
    """CRC-32 of a string of ASCII characters."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    each = f"list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: {step})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: {each}), 4294967295)"


def leaf_sql(*values: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({v})::VARCHAR) || ':' || ({v})::VARCHAR, '-')" for v in values) + ")"


def fold_sql(nodes: str, same: str) -> str:
    """One step of a walk up a tree of nodes (..., k, i, n, h) with cur and proof."""
    joined = f"JOIN {nodes} x ON {same.format('x')} AND x.k = f.k AND x.i = f.i AND x.n > 1 LEFT JOIN {nodes} y ON {same.format('y')} AND y.k = f.k AND y.i = xor(f.i, 1)"
    cur = "sha256(CASE WHEN f.i % 2 = 0 THEN f.cur || coalesce(y.h, '') ELSE y.h || f.cur END)"
    return f"f.k + 1, f.i // 2, {cur}, f.proof || coalesce(y.h, '') FROM {{}} f {joined}"


#: Costs of a row's own edit by state (0 nothing yet, 1 system, 2 user, 3 assistant last), c0 to c3 being those behind it.
OWN_SQL = ", ".join(
    f"least(3 + c{q}, CASE WHEN free THEN extra + least(2 + c{to}, {keep}) ELSE 1000000000000 END) AS b{q}"
    for q, to, keep in ((0, 2, "CASE init WHEN 's' THEN c1 WHEN 'u' THEN c2 ELSE 1000000000000 END"), *[(q, to, f"CASE init WHEN '{t}' THEN c{to} ELSE 1000000000000 END") for q, to, t in ((1, 2, "u"), (2, 3, "a"), (3, 2, "u"))])
)

ORACLE_SQL = {
    "op11_manifest": f"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS r, doc_id, lang, {leaf_sql("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
                   CASE WHEN n_chars IS NOT NULL AND {crc_sql("doc_id::VARCHAR")} % 7 = 0 THEN {leaf_sql("doc_id", "source", "lang", "n_chars::HUGEINT + 1", "text")} END AS bad
            FROM documents),
        l AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
                     count(*) OVER (PARTITION BY lang) AS n FROM d),
        t(tree, k, i, n, h) AS (SELECT tree, 0, idx, n, leaf FROM l
            UNION ALL SELECT tree, k + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY tree, k, i // 2),
        c(k, i, n, h) AS (SELECT 0, tree, count(*) OVER (), h FROM t WHERE n = 1
            UNION ALL SELECT k + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM c WHERE n > 1 GROUP BY k, i // 2),
        f(r, tree, k, i, cur, proof) AS (SELECT r, tree, 0, idx, coalesce(bad, leaf), '' FROM l
            UNION ALL SELECT f.r, f.tree, {fold_sql("t", "{}.tree = f.tree").format("f")}),
        g(r, k, i, cur, proof) AS (SELECT f.r, 0, f.tree, f.cur, f.proof FROM f JOIN t ON t.tree = f.tree AND t.k = f.k AND t.i = f.i AND t.n = 1
            UNION ALL SELECT f.r, {fold_sql("c", "TRUE").format("g")})
        SELECT doc_id, leaf, s.h AS subroot, z.h AS root, sha256(g.proof) AS proof_sha256, g.cur AS folded_root, g.cur = z.h AS verified
        FROM l JOIN t s ON s.tree = l.tree AND s.n = 1 JOIN c z ON z.n = 1 JOIN g ON g.r = l.r AND g.k = z.k
    """,
    "op13_structure": f"""
        WITH RECURSIVE ids AS (SELECT conv_id, row_number() OVER () AS v FROM (SELECT DISTINCT conv_id FROM conversations)),
        raw AS (SELECT v, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS lot
                FROM conversations c JOIN ids ON ids.conv_id IS NOT DISTINCT FROM c.conv_id),
        hurt AS (SELECT v, turn, CASE lot WHEN 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                        unnest(range(CASE lot WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM raw WHERE lot <> 0),
        told AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY v) AS n,
                        row_number() OVER (PARTITION BY v, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM hurt),
        w AS (SELECT *, left(role, 1) AS init, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM told),
        x AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS free, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS extra FROM w),
        cost(v, i, c0, c1, c2, c3) AS (SELECT DISTINCT v, n + 1, 0::BIGINT, 4::BIGINT, 2::BIGINT, 0::BIGINT FROM x
            UNION ALL SELECT v, i, least(b0, 2 + least(b2, 2 + b3)), least(b1, 2 + least(b2, 2 + b3)), least(b2, 2 + b3), least(b3, 2 + b2)
            FROM (SELECT x.v, x.i, {OWN_SQL} FROM cost JOIN x ON x.v = cost.v AND x.i = cost.i - 1)),
        go AS (SELECT x.*, list_value(now.c0, now.c1, now.c2, now.c3) AS a, list_value(nxt.c0, nxt.c1, nxt.c2, nxt.c3) AS b
               FROM x JOIN cost now ON now.v = x.v AND now.i = x.i JOIN cost nxt ON nxt.v = x.v AND nxt.i = x.i + 1),
        walk(v, i, q, audit, out) AS (SELECT DISTINCT v, 1::BIGINT, 1::INTEGER, '', []::VARCHAR[] FROM x
            UNION ALL SELECT v, CASE e WHEN 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN q WHEN 'K' THEN kept ELSE nx END, audit || e,
                             CASE e WHEN 'D' THEN out WHEN 'I' THEN list_append(out, new || ':') WHEN 'K' THEN list_append(out, role || ':' || text) ELSE list_append(out, new || ':' || text) END
            FROM (SELECT *, CASE WHEN i > n THEN 'I' WHEN a[q] = 3 + b[q] THEN 'D' WHEN a[q] = 2 + a[nx] THEN 'I' WHEN free AND kept > 0 AND a[q] = extra + b[kept] THEN 'K' ELSE 'R' END AS e
                  FROM (SELECT walk.*, role, text, free, extra, a, b, m.n, CASE q WHEN 3 THEN 4 ELSE 3 END AS nx, CASE q WHEN 3 THEN 'assistant' ELSE 'user' END AS new,
                               CASE WHEN init = 's' AND q = 1 THEN 2 WHEN init = 'u' AND q <> 3 THEN 3 WHEN init = 'a' AND q = 3 THEN 4 ELSE 0 END AS kept
                        FROM walk JOIN (SELECT DISTINCT v, n FROM x) m ON m.v = walk.v LEFT JOIN go ON go.v = walk.v AND go.i = walk.i)
                  WHERE i <= n OR q IN (2, 3))),
        done AS (SELECT v, arg_max(audit, length(audit)) AS audit, arg_max(out, length(audit)) AS out FROM walk GROUP BY v),
        total AS (SELECT v, max(c0) FILTER (WHERE i = 1) AS cost FROM cost GROUP BY v),
        pairs AS (SELECT *, lag(init) OVER (PARTITION BY v ORDER BY i) AS p FROM x),
        counts AS (SELECT v, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                          count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i > 1 AND p || init NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY v)
        SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(out, chr(10)), '')) AS repaired_sha256
        FROM ids LEFT JOIN counts USING (v) LEFT JOIN total USING (v) LEFT JOIN done USING (v)
    """,
    "op4_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
        b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
        pat AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS p
                FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
        lens AS (SELECT DISTINCT m FROM pat),
        win AS (SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS p FROM d, lens, unnest(range(1, len(w) - m + 2)) AS u(i)),
        occ AS (SELECT r, i, win.m, item_id FROM win JOIN pat USING (m, p)),
        hit AS (SELECT r, count(DISTINCT i + o) AS n_hit FROM occ, unnest(range(0, m)) AS u(o) GROUP BY r),
        it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM occ GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
    """,
    "op5_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({FOLD_SQL}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
              FROM w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
        r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
    """,
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}
