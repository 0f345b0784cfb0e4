"""A table function over trajectories: tagged steps in order, with the searches so far.

    SELECT * FROM split_steps(TABLE(t) PARTITION BY id ORDER BY turn)

``t`` has an id, a turn and a text in this order; the function keeps the number
of steps and searches of a trajectory from turn to turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf

from .tags import STEP_TAGS

_STEP = re.compile(rf"<({'|'.join(STEP_TAGS)})>(.*?)</\1>", re.I | re.S)


class SplitSteps:
    """Non-empty closed tags by place: (id, turn, step, step_type, content, search_count)."""

    def __init__(self) -> None:
        self.step, self.searches = 0, 0

    def eval(self, row: Row) -> Iterator[tuple]:
        own, turn, text = row[0], row[1], row[2] or ""
        for m in _STEP.finditer(text):
            kind, content = m[1].lower(), re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", m[2])
            if content:
                self.searches += kind == "search"
                yield str(own), int(turn), self.step, kind, content, self.searches
                self.step += 1


def register(spark: SparkSession) -> None:
    spark.udtf.register("split_steps", udtf(SplitSteps, returnType="id string, turn long, step int, step_type string, content string, search_count long"))


def split_steps(df: DataFrame, id_col: str, turn: str, text: str) -> DataFrame:
    """The function over a DataFrame: one task a trajectory, its turns in order."""
    spark = df.sparkSession
    register(spark)
    return spark.sql("SELECT s.* FROM split_steps(TABLE(SELECT * FROM {t}) PARTITION BY id ORDER BY turn) AS s", t=df.selectExpr(f"`{id_col}` AS id", f"CAST(`{turn}` AS BIGINT) AS turn", f"`{text}` AS text"))
