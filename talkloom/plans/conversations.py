"""Turns, evidence, folding and evaluation over the driver's conversations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from talkloom.functions import text as T
from talkloom.operators import evals, evidence, fold, render, turns
from talkloom.plans.common import table
from talkloom.plans.retrieval import terms_sql


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.split_turns(table(spark, sf_dir, "conversations"), thread="conv_id", seq="turn", role="role", prompt=F.col("role") == "user", out="turn_no")


SPLIT_SQL = """
    n AS (SELECT *, sum((role <> 'user')::INT) OVER w AS nu FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    p AS (SELECT *, max(CASE WHEN role = 'user' THEN nu END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pn FROM n),
    s AS (SELECT conv_id, turn, role, text, sum((role = 'user' AND (pn IS NULL OR nu > pn))::INT) OVER (PARTITION BY conv_id ORDER BY turn)::INT AS turn_no FROM p)"""


def turn_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir).select("conv_id", "turn", "turn_no")


def turn_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.turn_keys(split(spark, sf_dir), thread="conv_id", seq="turn", turn="turn_no", opening=F.col("text"))


def turn_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often openings begin with the same five characters over all conversations, for those that repeat."""
    first = split(spark, sf_dir).where("turn_no > 0").groupBy("conv_id", "turn_no").agg(F.min_by("text", "turn").alias("text"))
    prints = first.groupBy(T.short_hash(F.substring("text", 1, 5), 24).alias("print")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("n_conv"))
    return prints.where("n > 1")


def live_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.live_prompt(split(spark, sf_dir), thread="conv_id", seq="turn", turn="turn_no", text="text").select("conv_id", "turn_no", F.sha2("prompt", 256).alias("sha"))


def reply_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user message with the first assistant message behind it."""
    rows = table(spark, sf_dir, "conversations")
    ahead = W.partitionBy("conv_id").orderBy("turn").rowsBetween(1, W.unboundedFollowing)
    reply = F.first(F.when(F.col("role") == "assistant", F.struct("turn", "text")), ignorenulls=True).over(ahead)
    found = rows.withColumn("reply", reply).where("role = 'user' and reply is not null")
    return found.select("conv_id", F.col("turn").alias("user_turn"), F.col("reply.turn").alias("reply_turn"), F.length("reply.text").alias("reply_chars"))


# RE2 has no look-ahead: tokens are extracted first and tested afterwards.
def _has_sql(line: str) -> str:
    two = f"""len(list_filter(regexp_extract_all({line}, '(?i)\\b[a-z]{{2,}}[_-]([a-z0-9]{{6,}})\\b', 1), lambda x: regexp_matches(x, '[0-9]'))) > 0"""
    hexa = f"""len(list_filter(regexp_extract_all({line}, '(?i)\\b[0-9a-f]{{7,}}\\b'), lambda x: regexp_matches(x, '[0-9]') AND regexp_matches(x, '(?i)[a-f]'))) > 0"""
    rest = "(?i)https?://[^\\s)\"'']+|\\b\\d{6,}_[a-z0-9_]{3,}\\b|\\bv?\\d+\\.\\d+\\.\\d+\\b|\\bsha\\d*:[0-9a-f]+|@[a-z][\\w-]+|--[a-z][\\w-]*=\\S+"
    return f"({two} OR {hexa} OR regexp_matches({line}, '{rest}'))"


NUMBER_SQL = (
    "(?i)\\b\\d{4,}\\b|\\b\\d+(?:\\.\\d+)?\\s?(?:ms|s|[KMGT]i?B|kB|%)(?:[^a-z]|$)|"
    "\\b\\d+ (?:pass(?:ed|ing)?|fail(?:ed|ing)?|tests?|files? changed|insertions?|deletions?|rows?|errors?|warnings?)\\b|"
    "[$€£]\\d+(?:[.,]\\d+)?|\\b(?:status|HTTP/\\d(?:\\.\\d)?)\\s*[:=]?\\s*[45]\\d{2}\\b|\\bexit(?: code| status)?\\s*[:=]?\\s*(?:[1-9]\\d{0,2}|0\\d{1,2})\\b"
)
SCORED_SQL = f"""
    raw AS (SELECT doc_id, pos::INT - 1 AS pos, trim(ls[pos], ' ' || chr(9) || chr(13) || chr(160)) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(pos)),
    f AS (SELECT *, regexp_matches(l, '{T.ERROR_WORD}') OR regexp_matches(l, '{T.ERROR_CODE}') AS err, {_has_sql("l")} AS ident, regexp_matches(l, '{NUMBER_SQL}') AS num FROM raw WHERE length(l) >= 4),
    sc AS (SELECT doc_id, pos, trim(regexp_replace(l, '[\\s]+', ' ', 'g')) AS flat, (CASE WHEN err THEN 3 ELSE 0 END + CASE WHEN ident THEN 3 WHEN num THEN 2 ELSE 0 END
            + CASE WHEN regexp_matches(l, '{T.KEY_VALUE}') THEN 1 ELSE 0 END + CASE WHEN length(l) < 120 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(l, '{T.LABEL}') THEN 1 ELSE 0 END)::INT AS score
           FROM f WHERE err OR ident OR num),
    cl AS (SELECT doc_id, pos, CASE WHEN length(flat) > 220 THEN left(flat, 220) || '…' ELSE flat END AS line, score FROM sc WHERE score >= 2),
    once AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY score DESC, pos) = 1),
    nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS nth FROM once)"""


def salient_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.salient_lines(table(spark, sf_dir, "documents"), ["doc_id"], "text").select("doc_id", "pos", "line", "score")


def line_score_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.scored_lines(table(spark, sf_dir, "documents"), ["doc_id"], "text").groupBy("score").agg(F.count(F.lit(1)).alias("n_lines"))


def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of groups of ten documents, each document a call, under 4,000 characters."""
    docs = table(spark, sf_dir, "documents").withColumn("grp", F.floor(F.col("doc_id") / 10))
    head = F.concat(F.lit("document "), F.col("doc_id").cast("string"))
    found = evidence.turn_evidence(docs, turn=["grp"], call="doc_id", head=head, text="text")
    return found.select("grp", "used", F.length("evidence").alias("n_chars"), F.sha2("evidence", 256).alias("sha"))


EVIDENCE_SQL = f"""
    WITH {SCORED_SQL},
    o AS (SELECT doc_id // 10 AS grp, doc_id, pos, line, 'document ' || doc_id AS head,
                 row_number() OVER (PARTITION BY doc_id // 10 ORDER BY CASE WHEN nth <= 2 THEN 0 ELSE 1 END, CASE WHEN nth <= 2 THEN 0 ELSE -score END, doc_id, CASE WHEN nth <= 2 THEN nth ELSE pos END) AS k FROM nth),
    g AS (SELECT grp, list({{'d': doc_id, 'p': pos::BIGINT, 'l': line, 'h': head}} ORDER BY k) AS xs FROM o GROUP BY grp),
    w AS (SELECT grp, list_reduce(xs, lambda acc, x: CASE
              WHEN len(list_filter(acc.taken, lambda y: y.d = x.d)) >= 12
                OR acc.used + length(x.l) + 5 + CASE WHEN len(list_filter(acc.taken, lambda y: y.d = x.d)) > 0 THEN 0 ELSE length(x.h) + 4 END > 4000 THEN acc
              ELSE {{'used': acc.used + length(x.l) + 5 + CASE WHEN len(list_filter(acc.taken, lambda y: y.d = x.d)) > 0 THEN 0 ELSE length(x.h) + 4 END, 'taken': list_append(acc.taken, x)}} END,
              {{'used': 0::BIGINT, 'taken': []::STRUCT(d BIGINT, p BIGINT, l VARCHAR, h VARCHAR)[]}}) AS acc FROM g),
    t AS (SELECT grp, acc.used AS used, unnest(acc.taken) AS x FROM w),
    b AS (SELECT grp, used, x.d AS d, '- ' || x.h || ':' || chr(10) || string_agg('    ' || x.l, chr(10) ORDER BY x.p) AS block FROM t GROUP BY grp, used, x.d, x.h),
    e AS (SELECT grp, used, string_agg(block, chr(10) ORDER BY d) AS evidence FROM b GROUP BY grp, used)
    SELECT grp, used, length(evidence)::INT AS n_chars, sha256(evidence) AS sha FROM e"""


def folded_view_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded turns of each conversation: the newest in full while they fit in 1,500 characters."""
    rows = split(spark, sf_dir).select("conv_id", F.col("turn").alias("seq"), F.col("turn_no").alias("turn"), "role", "text")
    done = fold.folded_turns(rows, thread="conv_id", seq="seq", role="role", text="text")
    view = fold.folded_view(done, thread="conv_id", turn="turn", full=fold.rendered(True), short=fold.rendered(False), cap=1500)
    return view.select("conv_id", "turn", "is_full", F.sha2("text", 256).alias("sha"))


TRIM_SQL = "trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"
FOLDED_TURNS_SQL = f"""{SPLIT_SQL},
    m AS (SELECT conv_id, turn_no AS turn, turn AS seq, role, {TRIM_SQL.format("text")} AS said FROM s WHERE turn_no > 0),
    f AS (SELECT conv_id, turn, coalesce(string_agg(CASE WHEN role = 'user' AND said <> '' THEN said END, chr(10) || chr(10) ORDER BY seq), '') AS u,
                 coalesce(arg_max(said, seq) FILTER (role = 'assistant'), '') AS r FROM m GROUP BY conv_id, turn),
    v AS (SELECT *, '### Turn ' || turn || chr(10) || chr(10) || '**You:** ' || u AS short FROM f),
    x AS (SELECT *, short || CASE WHEN r <> '' THEN chr(10) || chr(10) || '**Agent:** ' || r ELSE '' END AS whole FROM v)"""
FOLDED_SQL = f"""
    WITH {FOLDED_TURNS_SQL},
    y AS (SELECT *, sum(length(whole)) OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 1500 AS is_full FROM x)
    SELECT conv_id, turn, is_full, sha256(CASE WHEN is_full THEN whole ELSE short END) AS sha FROM y"""


def carry_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct messages of a conversation, newest first, that fit in 600 characters."""
    taken = fold.carried(table(spark, sf_dir, "conversations"), thread="conv_id", seq="turn", text="text", most=600)
    return taken.select("conv_id", "used", F.size("taken").alias("n"), F.sha2(F.array_join("taken", "\n"), 256).alias("sha"))


CARRY_SQL = """
    WITH d AS (SELECT conv_id, text, max(turn) AS seen FROM conversations GROUP BY ALL),
    g AS (SELECT conv_id, list(text ORDER BY seen DESC, text) AS xs FROM d GROUP BY conv_id),
    w AS (SELECT conv_id, list_reduce(xs, lambda acc, x: CASE WHEN acc.used + length(x) > 600 THEN acc ELSE {'used': acc.used + length(x), 'taken': list_append(acc.taken, x)} END,
            {'used': 0::BIGINT, 'taken': []::VARCHAR[]}) AS acc FROM g)
    SELECT conv_id, acc.used AS used, len(acc.taken)::INT AS n, sha256(array_to_string(acc.taken, chr(10))) AS sha FROM w"""


def _turn_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir).where("turn_no > 0").groupBy("conv_id", F.col("turn_no").alias("turn")).agg(F.sum(F.length("text")).alias("size"))


def budget_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    budgets = spark.createDataFrame([(300,), (600,), (1200,)], "budget long")
    per = fold.budget_sweep(_turn_sizes(spark, sf_dir), budgets, thread="conv_id", turn="turn", size="size", keep=1)
    none = F.count(F.when(F.col("steps") == 0, 1))
    return per.groupBy("budget").agg(F.sum("steps").alias("steps"), F.max("peak").alias("peak"), F.sum("last").alias("gaps"), none.alias("without"), F.count(F.lit(1)).alias("n"))


SIZES_SQL = f"""
    {SPLIT_SQL}, q AS (SELECT conv_id, turn_no AS turn, sum(length(text))::BIGINT AS size, arg_min(text, turn) AS opening FROM s WHERE turn_no > 0 GROUP BY ALL),
    z AS (SELECT *, row_number() OVER w - 1 AS j, sum(size) OVER w - size AS pre FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""

SWEEP_SQL = f"""
    WITH RECURSIVE {SIZES_SQL},
    r AS (SELECT budget, conv_id, 1::BIGINT AS j, 0::HUGEINT AS at_cut, 0::BIGINT AS steps, 0::HUGEINT AS peak, 0::BIGINT AS last FROM z, (VALUES (300::BIGINT), (600), (1200)) AS b(budget) WHERE j = 0
          UNION ALL SELECT budget, r.conv_id, now.j, CASE WHEN nx.pre - at_cut > budget THEN nx.pre ELSE at_cut END, steps + (nx.pre - at_cut > budget)::INT,
                           greatest(peak, now.pre + now.size - at_cut), CASE WHEN nx.pre - at_cut > budget THEN now.j ELSE last END
          FROM r JOIN z now ON now.conv_id = r.conv_id AND now.j = r.j + 1 JOIN z nx ON nx.conv_id = r.conv_id AND nx.j = now.j - 1),
    e AS (SELECT budget, conv_id, arg_max(steps, j) AS steps, arg_max(peak, j) AS peak, arg_max(last, j) AS last FROM r GROUP BY ALL)
    SELECT budget, sum(steps)::BIGINT AS steps, max(peak)::BIGINT AS peak, sum(last)::BIGINT AS gaps, count(*) FILTER (steps = 0) AS without, count(*) AS n FROM e GROUP BY budget"""


def fold_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the rolling cut stands at each turn, with 400 characters of backlog; openings without a full stop stand in for interrupted ones."""
    rows = split(spark, sf_dir).where("turn_no > 0").groupBy("conv_id", F.col("turn_no").alias("turn"))
    sized = rows.agg(F.sum(F.length("text")).alias("size"), (~F.contains(F.min_by("text", "turn"), F.lit(". "))).alias("broken"))
    return fold.rolling_cut(sized, thread="conv_id", turn="turn", size="size", keep=1, budget=400, interrupted="broken")


def render_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as Markdown: assistant text before the last is narration."""
    part = "struct<kind:string,n:int,name:string,call:string,body:string,output:string,error:boolean,text:string>"
    rows = split(spark, sf_dir).where("turn_no > 0")
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(W.partitionBy("conv_id", "turn_no"))
    rows = rows.withColumn("last", last)
    none = F.lit(None).cast("string")
    say = F.struct(F.lit("say").alias("kind"), F.lit(None).cast("int").alias("n"), none.alias("name"), none.alias("call"), none.alias("body"), none.alias("output"), F.lit(False).alias("error"), F.col("text").alias("text")).cast(part)
    spoken = F.when((F.col("role") == "assistant") & (F.col("turn") < F.col("last")), F.struct(F.col("turn").alias("s"), say.alias("p")))
    per = rows.groupBy("conv_id", F.col("turn_no").alias("number")).agg(
        F.min_by("text", "turn").alias("prompt"), F.transform(F.array_sort(F.collect_list(spoken)), lambda x: x["p"]).alias("parts"),
        F.coalesce(F.max(F.when(F.col("turn") == F.col("last"), F.col("text"))), F.lit("")).alias("final"),
    )
    done = per.withColumns({"time": F.lit(""), "calls": F.lit(0)})
    return done.select("conv_id", render.turn_file(F.col("number")).alias("file"), render.markdown().alias("content"))


def tally_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of good documents by size class and over all, labels against documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") < 500, "small").when(F.col("n_chars") < 5000, "middle").otherwise("large").alias("bucket"))
    return evals.tally(table(spark, sf_dir, "labels").join(docs, "doc_id"), ["bucket"], F.col("quality") == 1)


TALLY_SQL = """
    WITH j AS (SELECT CASE WHEN n_chars < 500 THEN 'small' WHEN n_chars < 5000 THEN 'middle' ELSE 'large' END AS bucket, quality FROM labels JOIN documents USING (doc_id)),
    t AS (SELECT coalesce(bucket, 'all') AS bucket, sum((quality = 1)::INT)::BIGINT AS hits, count(*) AS total FROM j GROUP BY GROUPING SETS ((bucket), ()))
    SELECT bucket, hits, total, floor(100.0::DOUBLE * hits / total + 0.5)::BIGINT AS pct FROM t"""


def verdict_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on conversations: the answer is the first word of the first message, a stale value the first word of the second."""
    rows = table(spark, sf_dir, "conversations")
    word = lambda t: F.regexp_extract(F.max(F.when(F.col("turn") == t, F.col("text"))), "[A-Za-z]+", 0)
    facts = rows.groupBy("conv_id").agg(word(0).alias("answer"), word(1).alias("stale"), F.max_by("text", "turn").alias("response"))
    facts = facts.where("answer <> '' and stale <> ''").withColumn("verdict", evals.verdict(F.lit("tool_value"), F.col("answer"), F.col("stale"), F.col("response")))
    return facts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean length of documents by source and language, each language against English over the sources both have."""
    scores = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.avg("n_chars").alias("value"))
    out = evals.paired(scores, unit="source", arm="lang", value="value", baseline="en")
    return out.select("lang", "n", F.round("mean_diff", 4).alias("mean_diff"), F.round("sd", 4).alias("sd"))


PAIRED_SQL = """
    WITH s AS (SELECT source, lang, avg(n_chars) AS v FROM documents GROUP BY ALL), b AS (SELECT source, v AS base FROM s WHERE lang = 'en')
    SELECT lang, count(*) AS n, round(avg(v - base), 4) AS mean_diff, round(stddev_samp(v - base), 4) AS sd FROM s JOIN b USING (source) WHERE lang <> 'en' GROUP BY lang"""


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.avg("n_chars").alias("value"))
    base = scores.where("lang = 'en'").select("source", F.col("value").alias("base"))
    diffs = scores.where("lang <> 'en'").join(base, "source").select("lang", "source", (F.col("value") - F.col("base")).alias("diff"))
    return evals.bootstrap(diffs, "lang", "source", "diff", draws=1000)


def extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects found in replies made of event properties inside prose."""
    reply = F.concat(F.lit("Here you go:\n```json\n"), F.regexp_replace("props", "}$", ",}"), F.lit("\n``` done"))
    return table(spark, sf_dir, "events").select("event_id", evals.extract_json(reply).alias("object"))


def first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the first line of a document that mentions a long or numbered term of its first line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("ls"))
    keyed = docs.select("doc_id", T.key_tokens(F.col("ls")[0]).alias("ks"), F.posexplode("ls").alias("pos", "line")).where("pos > 0")
    return evals.first_hit(keyed, "doc_id", "pos", T.mentions(F.col("line"), F.col("ks")))


QUERIES = {
    f.__name__: f
    for f in (turn_split, turn_keys, turn_repeat, live_prompt, reply_pairs, salient_lines, line_score_hist, evidence_budget, folded_view_cap, carry_dedupe, budget_sweep, fold_state,
              render_markdown, tally_by_bucket, verdict_table, paired_delta, bootstrap_ci, extract_json, first_hit)
}
ORACLE_SQL = {
    "turn_split": f"WITH {SPLIT_SQL} SELECT conv_id, turn, turn_no FROM s",
    "turn_keys": f"""
        WITH {SPLIT_SQL}, f AS (SELECT conv_id, turn_no, left(sha256(arg_min(text, turn)), 24) AS print FROM s WHERE turn_no > 0 GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, print ORDER BY turn_no) - 1 AS again FROM f)
        SELECT conv_id, turn_no, CASE WHEN again = 0 THEN print ELSE print || '~' || again END AS key FROM k""",
    "turn_repeat": f"""
        WITH {SPLIT_SQL}, f AS (SELECT conv_id, turn_no, left(sha256(left(arg_min(text, turn), 5)), 24) AS print FROM s WHERE turn_no > 0 GROUP BY ALL)
        SELECT print, count(*) AS n, count(DISTINCT conv_id) AS n_conv FROM f GROUP BY print HAVING count(*) > 1""",
    "live_prompt": f"""
        WITH {SPLIT_SQL}, f AS (SELECT conv_id, turn_no, arg_min(text, turn) AS prompt FROM s WHERE turn_no > 0 GROUP BY ALL)
        SELECT conv_id, max(turn_no) AS turn_no, sha256(trim(arg_max(prompt, turn_no), ' ')) AS sha FROM f GROUP BY conv_id""",
    "reply_pairs": """
        WITH u AS (SELECT * FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn AS reply_turn, text AS reply FROM conversations WHERE role = 'assistant')
        SELECT conv_id, turn AS user_turn, min(reply_turn) AS reply_turn, arg_min(length(reply), reply_turn)::INT AS reply_chars FROM u JOIN a USING (conv_id) WHERE reply_turn > turn GROUP BY ALL""",
    "salient_lines": f"WITH {SCORED_SQL} SELECT doc_id, pos, line, score FROM nth WHERE nth <= 12",
    "line_score_hist": f"WITH {SCORED_SQL} SELECT score, count(*) AS n_lines FROM nth GROUP BY score",
    "evidence_budget": EVIDENCE_SQL,
    "folded_view_cap": FOLDED_SQL,
    "carry_dedupe": CARRY_SQL,
    "budget_sweep": SWEEP_SQL,
    "fold_state": f"""
        WITH RECURSIVE {SIZES_SQL},
        y AS (SELECT *, max(j) FILTER (j <= 1 OR contains(opening, '. ')) OVER (PARTITION BY conv_id ORDER BY j) AS place FROM z),
        r AS (SELECT conv_id, turn, j, 0::BIGINT AS cut, 0::HUGEINT AS at_cut, false AS rolled FROM y WHERE j = 0
              UNION ALL SELECT r.conv_id, now.turn, now.j, CASE WHEN pl.j > cut AND pl.pre - at_cut > 400 THEN pl.j ELSE cut END, CASE WHEN pl.j > cut AND pl.pre - at_cut > 400 THEN pl.pre ELSE at_cut END,
                               pl.j > cut AND pl.pre - at_cut > 400
              FROM r JOIN y now ON now.conv_id = r.conv_id AND now.j = r.j + 1 JOIN y nx ON nx.conv_id = r.conv_id AND nx.j = now.j - 1 JOIN y pl ON pl.conv_id = r.conv_id AND pl.j = nx.place)
        SELECT conv_id, turn, cut, rolled FROM r""",
    "render_markdown": f"""
        WITH {SPLIT_SQL}, g AS (SELECT *, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id, turn_no) AS last FROM s WHERE turn_no > 0),
        y AS (SELECT conv_id, turn_no, arg_min(text, turn) AS prompt, string_agg('> ' || replace(text, chr(10), chr(10) || '> '), chr(10) || chr(10) ORDER BY turn) FILTER (role = 'assistant' AND turn < last) AS work,
                     coalesce(max(text) FILTER (turn = last), '') AS final FROM g GROUP BY ALL)
        SELECT conv_id, 'turn-' || lpad(turn_no::VARCHAR, 4, '0') || '.md' AS file, array_to_string(['# Turn ' || turn_no, '', '## User', '', prompt, '', '## Work (0 tool calls)', '', coalesce(work, '_No tool calls._'), '', '## Final reply', '',
               CASE WHEN final <> '' THEN final ELSE '_No final reply: the turn was interrupted or is still running._' END, ''], chr(10)) AS content FROM y""",
    "extract_json": """SELECT event_id, '{"k": ' || (props->>'$.k') || '}' AS object FROM events""",
    "tally_by_bucket": TALLY_SQL,
    "paired_delta": PAIRED_SQL,
    "first_hit": f"""
        WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), d AS (SELECT doc_id, ls, list_distinct({terms_sql("ls[1]")}) AS ts FROM l WHERE len(ls) > 1),
        k AS (SELECT doc_id, ls, CASE WHEN len([t FOR t IN ts IF length(t) >= 6 OR regexp_matches(t, '[0-9]')]) > 0 THEN [t FOR t IN ts IF length(t) >= 6 OR regexp_matches(t, '[0-9]')] ELSE [t FOR t IN ts IF length(t) >= 4] END AS ks FROM d),
        h AS (SELECT doc_id, pos, len(list_filter(ks, lambda t: contains(lower(ls[pos + 1]), t))) > 0 AS hit FROM k, unnest(range(1, len(ls))) AS u(pos))
        SELECT doc_id, coalesce(min(pos) FILTER (hit), 999)::INT AS first_hit FROM h GROUP BY doc_id""",
}
