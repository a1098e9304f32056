"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stepweave.llm.ann import op8_nearest
from stepweave.llm.decontaminate import OP7_SQL, op7_decontamination
from stepweave.llm.hmm import op3_hmm
from stepweave.llm.language_id import op5_language_id
from stepweave.llm.packing import op10_packing
from stepweave.llm.secrets import OP2_SQL, op2_secrets
from stepweave.llm.simhash import op1_simhash
from stepweave.llm.suffix_dedup import op6_suffix_dedup
from stepweave.llm.token_output import op9_token_records
from stepweave.llm.url_filter import OP4_SQL, op4_url_filter

OPERATORS = (op1_simhash, op2_secrets, op3_hmm, op4_url_filter, op5_language_id, op6_suffix_dedup, op7_decontamination, op8_nearest, op9_token_records, op10_packing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    """Where SQL can say the same; the others are tested against brute force, round trips or held-out accuracy."""
    return {"op2_secrets": OP2_SQL, "op4_url_filter": OP4_SQL, "op7_decontamination": OP7_SQL}
