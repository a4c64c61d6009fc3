"""The subpackage's registered queries: each operator over its whole table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import langid, lm, media, mixing, neardup, packing, secrets, tokencount, topk, toxicity
from .common import table


def _over(name: str, f: Callable[..., DataFrame], *more: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(*(table(spark, sf_dir, t) for t in (name, *more)))

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": _over("documents", secrets.run),
        "op2_media_columns": _over("documents", media.run),
        "op3_toxicity": _over("documents", toxicity.run, "labels"),
        "op4_packing": _over("documents", packing.run),
        "op5_language_id": _over("documents", langid.run),
        "op6_exact_topk": _over("embeddings", topk.run),
        "op7_token_counts": _over("documents", tokencount.run),
        "op8_lm_scoring": _over("documents", lm.run),
        "op9_mixing": _over("documents", mixing.run),
        "op10_near_dedup": _over("documents", neardup.run),
    }


#: DuckDB SQL of the operators that it can express.
ORACLE_SQL: dict[str, str] = {
    "op6_exact_topk": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
}
