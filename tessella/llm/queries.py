"""The registered queries of the subpackage, each over a whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import spread
from .chroma import op10_chroma
from .fingerprint import op5_fingerprint
from .language import op7_language
from .linededup import OP4_SQL, op4_line_dedup
from .lmscore import op6_score
from .mixing import op1_mix
from .packing import op9_pack
from .partenum import op3_near_duplicates
from .personal import op2_personal_data
from .warc import OP8_SQL, op8_archive
from .work import reachable


def _over(table: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(spread(reachable(spark).read.parquet(f"{sf_dir}/{table}.parquet")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix": _over("documents", op1_mix),
        "op2_personal_data": _over("documents", op2_personal_data),
        "op3_near_duplicates": _over("documents", op3_near_duplicates),
        "op4_line_dedup": _over("documents", op4_line_dedup),
        "op5_fingerprint": _over("documents", op5_fingerprint),
        "op6_score": _over("documents", op6_score),
        "op7_language": _over("documents", op7_language),
        "op8_archive": _over("pages", op8_archive),
        "op9_pack": _over("documents", op9_pack),
        "op10_chroma": _over("embeddings", op10_chroma),
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op8_archive": OP8_SQL}
