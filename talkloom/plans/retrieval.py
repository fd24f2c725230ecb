"""Retrieval queries over documents, benchmark, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from talkloom.functions import text as T
from talkloom.operators import retrieval as R
from talkloom.plans.common import table

STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(T.STOP_WORDS)) + "]"


def terms_sql(x: str) -> str:
    found = f"regexp_extract_all(lower({x}), '{T.TERM}')"
    parts = f"flatten([CASE WHEN regexp_matches(t, '{T.COMPOUND}') THEN list_concat([t], regexp_split_to_array(t, '{T.COMPOUND}+')) ELSE [t] END FOR t IN {found}])"
    return f"[t FOR t IN {parts} IF length(t) >= 3 AND NOT list_contains({STOP_SQL}, t)]"


def bm25_sql(queries: str, docs: str, key: str, least: int) -> str:
    """CTEs ending in `scored` (q, key, matched, score) from queries (q, terms) and docs (key, terms)."""
    return f"""
        q_ AS ({queries}), d_ AS ({docs}),
        asked AS (SELECT DISTINCT q, unnest(terms) AS term FROM q_),
        stats AS (SELECT count(*)::DOUBLE AS n, avg(len(terms)::DOUBLE) AS avg_len FROM d_),
        tf AS (SELECT {key}, len, term, count(*)::DOUBLE AS f FROM (SELECT {key}, len(terms) AS len, unnest(terms) AS term FROM d_)
               WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
        need AS (SELECT q, greatest(1, least({least}, count(*))) AS need FROM asked JOIN df USING (term) GROUP BY q),
        parts AS (SELECT q, {key}, ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * f * 2.2::DOUBLE
                         / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len)) AS part
                  FROM tf JOIN df USING (term) JOIN asked USING (term), stats),
        sums AS (SELECT q, {key}, count(*) AS matched, sum(part) AS score FROM parts GROUP BY ALL),
        scored AS (SELECT sums.* FROM sums JOIN need USING (q) WHERE matched >= need)"""


def terms_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.terms(F.col("text"))).alias("term"))
    per_doc = docs.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _bm25(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    scored = R.bm25(
        table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), query_id="item_id", query_terms=T.terms(F.col("text")),
        doc_key=["doc_id"], doc_terms=T.terms(F.col("text")), min_terms=least,
    )
    return R.ranked(scored, "item_id", ["doc_id"], 12).select("item_id", "rank", "doc_id", "matched", F.round("score", 6).alias("score"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 2)


def bm25_min1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 1)


def _bm25_sql(least: int) -> str:
    return f"""
        WITH {bm25_sql(f"SELECT item_id AS q, {terms_sql('text')} AS terms FROM benchmark", f"SELECT doc_id, {terms_sql('text')} AS terms FROM documents", "doc_id", least)},
        r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)
        SELECT q AS item_id, rank, doc_id, matched, round(score, 6) AS score FROM r WHERE rank <= 12"""


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.line_windows(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", "chunk", F.size("lines").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("sha"))


CHUNKS_SQL = """
    l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
    chunks AS (SELECT doc_id, c::INT AS chunk, ls[c * 6 + 1 : c * 6 + 6] AS lines FROM l, unnest(range(0, (len(ls) - 1) // 6 + 1)) AS u(c))"""


def chunk_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = R.line_windows(table(spark, sf_dir, "documents"), "doc_id", "text")
    scored = R.bm25(
        table(spark, sf_dir, "benchmark"), chunks, query_id="item_id", query_terms=T.terms(F.col("text")), doc_key=["doc_id", "chunk"],
        doc_terms=T.terms(F.array_join("lines", "\n")),
    )
    return R.ranked(scored, "item_id", ["doc_id", "chunk"], 12).select("item_id", "rank", "doc_id", "chunk", "matched", F.round("score", 6).alias("score"))


CHUNK_BM25_SQL = f"""
    WITH {CHUNKS_SQL}, {bm25_sql(f"SELECT item_id AS q, {terms_sql('text')} AS terms FROM benchmark", f"SELECT doc_id, chunk, {terms_sql('array_to_string(lines, chr(10))')} AS terms FROM chunks", "doc_id, chunk", 2)},
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc_id, chunk) AS rank FROM scored)
    SELECT q AS item_id, rank, doc_id, chunk, matched, round(score, 6) AS score FROM r WHERE rank <= 12"""


def term_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of four letters and more in at least two and at most a quarter of the chunks: the 400 most frequent."""
    return R.term_pool(R.line_windows(table(spark, sf_dir, "documents"), "doc_id", "text"), T.terms(F.array_join("lines", "\n")))


TERM_POOL_SQL = f"""
    WITH {CHUNKS_SQL}, t AS (SELECT list_distinct({terms_sql("array_to_string(lines, chr(10))")}) AS ts FROM chunks),
    d AS (SELECT term, count(*) AS df FROM (SELECT unnest(ts) AS term FROM t) WHERE length(term) >= 4 GROUP BY term)
    SELECT term, df FROM d WHERE df >= 2 AND df <= (SELECT count(*) FROM t) / 4 ORDER BY df DESC, term LIMIT 400"""


def excerpt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching lines and their neighbours of each benchmark item's three best documents."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.terms(F.col("text"))).alias("q"))
    best = _bm25(spark, sf_dir, 2).where("rank <= 3").select("item_id", "doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    rows = best.join(items, "item_id").join(docs, "doc_id")
    return R.excerpt_lines(rows, ["item_id", "doc_id"], "lines", "q", salient=False)


EXCERPT_SQL = f"""
    WITH best AS (SELECT item_id, doc_id FROM ({_bm25_sql(2)}) WHERE rank <= 3),
    i AS (SELECT item_id, {terms_sql("text")} AS q FROM benchmark),
    l AS (SELECT item_id, doc_id, pos::INT - 1 AS pos, ls[pos] AS line, q FROM best JOIN i USING (item_id) JOIN (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) USING (doc_id),
          unnest(range(1, len(ls) + 1)) AS u(pos)),
    h AS (SELECT *, list_has_any({terms_sql("line")}, q) AS hit FROM l),
    n AS (SELECT *, max(hit) OVER (PARTITION BY item_id, doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM h),
    s AS (SELECT *, bool_or(near) OVER (PARTITION BY item_id, doc_id) AS found FROM n),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY pos) AS k FROM s WHERE near OR (NOT found AND pos = 0)),
    c AS (SELECT item_id, doc_id, pos, trim(regexp_replace(line, '[\\s]+', ' ', 'g')) AS flat FROM r WHERE k <= 8)
    SELECT item_id, doc_id, pos, CASE WHEN length(flat) > 240 THEN left(flat, 240) || '…' ELSE flat END AS line FROM c WHERE flat <> ''"""


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rows of every twentieth vector among all rows."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.dense_topk(queries, rows, query_id="query_id", query_vec="q", key="vec_id", vec="embedding", k=10).select("query_id", "vec_id", "rank", "score")


DENSE_SQL = """
    WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS score
               FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, rank, score FROM r WHERE rank <= 10"""


def _label_list(rows: DataFrame) -> DataFrame:
    """A second list for fusion: the ten rows of the query's label with the nearest identifiers.

    They are among its ten neighbours on either side in the order of identifiers, so a frame finds them and no pair is made.
    """
    order = W.partitionBy("label").orderBy("vec_id")
    ids = [F.collect_list("vec_id").over(order.rowsBetween(*frame)) for frame in ((-10, -1), (1, 10))]
    near = rows.select("vec_id", F.concat(*ids).alias("near")).where("vec_id % 20 = 0")
    pairs = near.select(F.col("vec_id").alias("query_id"), F.explode("near").alias("vec_id")).withColumn("gap", F.abs(F.col("query_id") - F.col("vec_id")))
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("gap", "vec_id"))).where("rank <= 10")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = [dense_topk(spark, sf_dir), _label_list(table(spark, sf_dir, "embeddings").select("vec_id", "label"))]
    return R.fused(lists, "query_id", ["vec_id"]).select("query_id", "vec_id", "rank", F.round("score", 9).alias("score"))


def vote_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = [dense_topk(spark, sf_dir), _label_list(table(spark, sf_dir, "embeddings").select("vec_id", "label"))]
    return R.fused(lists, "query_id", ["vec_id"], 0.0).where("rank = 1").select("query_id", "vec_id", F.round("score", 9).alias("score"))


FUSION_SQL = f"""
    WITH dense AS (SELECT query_id, vec_id, rank FROM ({DENSE_SQL})),
    near AS (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY abs(a.vec_id - b.vec_id), b.vec_id) AS rank
             FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
    u AS (SELECT * FROM dense UNION ALL SELECT * FROM near WHERE rank <= 10),
    f AS (SELECT query_id, vec_id, sum(1.0::DOUBLE / (CONSTANT + rank)) AS score FROM u GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM f)"""


def session_outline_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations ranked by BM25 of their outlines (240 characters of each user message) for every twentieth conversation's last user message."""
    said = table(spark, sf_dir, "conversations").where("role = 'user'")
    asks = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.substring(F.trim("text"), 1, 240).alias("t")))), lambda x: x["t"])
    outlines = said.groupBy("conv_id").agg(F.array_join(asks, "\n").alias("outline"))
    prompts = said.where("conv_id % 20 = 0").groupBy("conv_id").agg(F.max_by("text", "turn").alias("prompt")).withColumnRenamed("conv_id", "query_id")
    scored = R.bm25(prompts, outlines, query_id="query_id", query_terms=T.terms(F.col("prompt")), doc_key=["conv_id"], doc_terms=T.terms(F.col("outline")))
    return R.ranked(scored, "query_id", ["conv_id"], 5).select("query_id", "conv_id", "rank", "matched", F.round("score", 6).alias("score"))


OUTLINE_SQL = f"""
    WITH o AS (SELECT conv_id, string_agg(left(trim(text, ' '), 240), chr(10) ORDER BY turn) AS outline FROM conversations WHERE role = 'user' GROUP BY conv_id),
    p AS (SELECT conv_id, arg_max(text, turn) AS prompt FROM conversations WHERE role = 'user' AND conv_id % 20 = 0 GROUP BY conv_id),
    {bm25_sql(f"SELECT conv_id AS q, {terms_sql('prompt')} AS terms FROM p", f"SELECT conv_id, {terms_sql('outline')} AS terms FROM o", "conv_id", 2)},
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, conv_id) AS rank FROM scored)
    SELECT q AS query_id, conv_id, rank, matched, round(score, 6) AS score FROM r WHERE rank <= 5"""


def recall_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of documents recalled for each benchmark item under a budget of 2,000 characters."""
    windows = R.line_windows(table(spark, sf_dir, "documents"), "doc_id", "text")
    chunks = windows.select((F.col("doc_id") * (1 << 24) + F.col("chunk")).alias("chunk"), F.col("doc_id").alias("turn"), F.lit(None).cast("string").alias("source"), F.lit("document").alias("call"), "lines")
    return R.recall(table(spark, sf_dir, "benchmark"), chunks, prompt_id="item_id", prompt="text", most=2000, most_multi=3000)


QUERIES = {f.__name__: f for f in (terms_df, bm25_topk, bm25_min1, chunk_windows, chunk_bm25, term_pool, excerpt_lines, dense_topk, rrf_fusion, vote_fusion, session_outline_rank, recall_text)}
ORACLE_SQL = {
    "terms_df": f"""
        WITH t AS (SELECT doc_id, unnest({terms_sql("text")}) AS term FROM documents)
        SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term""",
    "bm25_topk": _bm25_sql(2),
    "bm25_min1": _bm25_sql(1),
    "chunk_windows": f"WITH {CHUNKS_SQL} SELECT doc_id, chunk, len(lines)::INT AS n_lines, sha256(array_to_string(lines, chr(10))) AS sha FROM chunks",
    "chunk_bm25": CHUNK_BM25_SQL,
    "term_pool": TERM_POOL_SQL,
    "excerpt_lines": EXCERPT_SQL,
    "dense_topk": DENSE_SQL,
    "rrf_fusion": FUSION_SQL.replace("CONSTANT", "60") + " SELECT query_id, vec_id, rank, round(score, 9) AS score FROM r",
    "vote_fusion": FUSION_SQL.replace("CONSTANT", "0") + " SELECT query_id, vec_id, round(score, 9) AS score FROM r WHERE rank = 1",
    "session_outline_rank": OUTLINE_SQL,
}
