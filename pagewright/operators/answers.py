"""M3, M7: a store of model answers, so that a prompt is paid for once.

Prompts are known by a hash of their text.  Equal prompts are asked once, whichever pages they come
from; prompts that the store has an answer for are not asked at all; answers go back to all rows
that share the prompt.  A failed call leaves nothing in the store and is made again by the next run.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.annotate import annotate

_STORED = "prompt_key string, answer string"


def stored_answers(spark: SparkSession, store: str) -> DataFrame:
    """prompt_key and answer of every prompt that was ever answered; none if the store does not exist yet.

    Two runs at a time may both answer a prompt: the smaller answer counts.
    """
    try:
        rows = spark.read.schema(_STORED).parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STORED)
    return rows.groupBy("prompt_key").agg(F.min("answer").alias("answer"))


def ask(rows: DataFrame, model: Callable[[list[str]], list[str | None]], store: str, prompt: str = "prompt",
        calls: int | None = None) -> DataFrame:
    """The rows with ``answer``, from the store or from the model; null where the prompt is null or the call failed.

    `model` gets the prompts of an Arrow batch and returns as many answers, null for a failure; if it
    raises, all of these failed.  `calls` is the number of tasks that call it at a time at most.  New answers are in the store when this returns.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("prompt_key", F.sha2(prompt, 256))
    asked = keyed.where(F.col(prompt).isNotNull()).groupBy("prompt_key").agg(F.min(prompt).alias("prompt"))
    missing = asked.join(stored_answers(spark, store).select("prompt_key"), "prompt_key", "left_anti")
    if calls is not None:
        missing = missing.repartition(calls, "prompt_key")

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        answers: list[str | None] = [None] * len(batch)
        if len(batch):
            try:
                answers = list(model(batch["prompt"].tolist()))
            except Exception:  # whatever it is, it is these calls' failure
                pass
            if len(answers) != len(batch):
                raise ValueError("a model returns one answer for each prompt")
        return pd.DataFrame({"prompt_key": batch["prompt_key"], "answer": pd.Series(answers, dtype=object, index=batch.index)})

    annotate(missing, call, _STORED).where("answer IS NOT NULL").write.mode("append").parquet(store)
    return keyed.join(stored_answers(spark, store), "prompt_key", "left").drop("prompt_key")
