"""Answers that are worked out once for each key and kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from talkloom.sources.index import _exists
from talkloom.sources.tables import written


def kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All answers so far, from batches that were committed."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    done = [f"{path}/{n}" for n in names if n.startswith("batch=") and _exists(spark, f"{path}/{n}/_SUCCESS")]
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def answered_once(asked: DataFrame, path: str, *, key: list[str], answer: str, work: Callable[[DataFrame], DataFrame], batch: str) -> DataFrame:
    """The kept answers (key, answer) with those of this batch's new keys.

    work takes the rows of keys without an answer and gives (key, answer) for some of them; the others are kept
    with the empty answer, so that nothing is worked out for them again.  It is not called where no key is
    new.  A batch that is committed is not looked at again, one that died is written anew, and what other
    batches answered stays.  Of a key that `asked` repeats one row goes to work.  Null keys are left out.
    """
    spark = asked.sparkSession
    kinds = dict(asked.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in key] + [f"`{answer}` string"])
    folder = f"{path}/batch={batch}"
    if not _exists(spark, f"{folder}/_SUCCESS"):
        known = kept(spark, path, schema)
        new = written(asked.dropna(subset=key).dropDuplicates(key).join(known.select(*key), key, "left_anti"), "once-new")
        if new.limit(1).count():
            found = work(new).select(*key, F.col(answer).alias("__answer"))
            out = new.select(*key).join(found, key, "left").select(*key, F.coalesce("__answer", F.lit("")).alias(answer))
        else:
            out = spark.createDataFrame([], schema)
        out.write.mode("overwrite").parquet(folder)
    return kept(spark, path, schema)
