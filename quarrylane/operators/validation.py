"""Validation: split rows, run settings, row counts of an index, and statements that compile (VAL-2, FLT-7, FLT-8, SRC-9, EXE-5)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.functions.sqlparse import parse_table, split_outside
from quarrylane.operators.execution import to_spark_sql


def split_report(rows: DataFrame, required: list[str], id_: str, expected_split: Column | None = None, prefix: str | None = None) -> DataFrame:
    """One row: ``n_rows``, blank values by required column, repeated ids, and rows of another split or with another id prefix.

    Blank is null or white space only.  Everything is one aggregation and one grouping of ids.
    """
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    counts = [F.count("*").alias("n_rows"), *(F.count_if(blank(c)).alias(f"blank_{c}") for c in required)]
    counts.append(F.count_if(~F.coalesce(expected_split, F.lit(False)) if expected_split is not None else F.lit(False)).alias("other_split"))
    counts.append(F.count_if(~F.coalesce(F.col(id_).cast("string").startswith(prefix), F.lit(False)) if prefix is not None else F.lit(False)).alias("other_prefix"))
    repeated = rows.groupBy(id_).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("repeated_ids"))
    return rows.agg(*counts).crossJoin(repeated)


def validate_split(rows: DataFrame, required: list[str], id_: str, expected: int, expected_split: Column | None = None, prefix: str | None = None) -> None:
    """Raises for a split that misses rows, values, or unique ids; the message names every failure."""
    found = split_report(rows, required, id_, expected_split, prefix).first().asDict()
    failures = [f"{name}: {n}" for name, n in found.items() if name != "n_rows" and n]
    if found["n_rows"] != expected:
        failures.insert(0, f"expected {expected} rows, found {found['n_rows']}")
    if failures:
        raise ValueError("split is not valid: " + "; ".join(failures))


def identities(old: DataFrame, new: DataFrame, key: str, id_: str, columns: tuple[str, ...]) -> DataFrame:
    """One row: pairs of an old and another new row of one key, how many agree in each column, and whether all do in all."""
    before = old.select(F.col(key).alias("_key"), F.col(id_).alias("_id"), *[F.col(c).alias(f"_old_{c}") for c in columns])
    pairs = new.join(before, F.col(key) == F.col("_key")).where(F.col(id_) != F.col("_id"))
    same = {c: F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in columns}
    every = F.lit(True)
    for flag in same.values():
        every = every & flag
    return pairs.agg(F.count("*").alias("n"), *[F.count_if(flag).alias(f"same_{c}") for c, flag in same.items()], F.coalesce(F.bool_and(every), F.lit(True)).alias("holds"))


def check_index(index: DataFrame, metadata: DataFrame) -> int:
    """The number of rows of a vector index, which has to be that of its metadata."""
    n, m = index.count(), metadata.count()
    if n != m:
        raise ValueError(f"the index has {n} rows and its metadata {m}")
    return n


def first_cases(rows: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first ``n`` rows for a smoke run; all without a limit."""
    return rows if n is None else rows.orderBy(order).limit(n)


#: What the settings of a run may be.
PROMPTS_WITH_EXAMPLES = ("static_fewshot", "dynamic_fewshot")
RERANK_METHODS = ("none", "sqlaware_topk", "structure_topk_v2")
SCHEMA_MODES = ("full", "sql_relevant_only")
EXAMPLE_MODES = ("schema_with_rules", "question_sql_only")
GATE_MODES = ("similarity_only", "weighted_score", "rerank_similarity")
GATE_FEATURES = ("sqlaware_structure_bonus",)
EXTRACTORS = ("legacy", "robust_v2", "robust_v3", "sql_first_statement_only", "first_statement")
RETRIEVAL_METHOD = "sentence_transformer_faiss"


@dataclass(frozen=True)
class RunSettings:
    """Settings of one evaluation run."""

    testcases_path: str = ""
    traincases_path: str = ""
    prompt_tuning: str = "zero_shot"
    k: int = 1
    retrieval_pool_path: str = ""
    retrieval_index_path: str = ""
    retrieval_method: str = RETRIEVAL_METHOD
    retrieval_rerank_method: str = "none"
    retrieval_rerank_top_n: int = 10
    retrieval_structure_bonus_max: float = 0.08
    fewshot_rerank_top_n: int | None = None
    fewshot_example_schema_mode: str = "full"
    fewshot_example_mode: str = "schema_with_rules"
    fewshot_gate_enabled: bool = False
    fewshot_gate_mode: str = "similarity_only"
    fewshot_gate_threshold: float | None = None
    fewshot_gate_features: tuple[str, ...] = field(default=())
    extractor_mode: str = "legacy"

    @property
    def dynamic(self) -> bool:
        return self.prompt_tuning == "dynamic_fewshot"

    @property
    def with_examples(self) -> bool:
        return self.prompt_tuning in PROMPTS_WITH_EXAMPLES


#: (what is wrong, whether it is) of every rule; rules are independent of each other.
SETTING_RULES: list[tuple[str, Callable[[RunSettings], bool]]] = [
    ("testcases_path is empty", lambda s: not s.testcases_path),
    ("traincases_path is empty", lambda s: not s.traincases_path),
    ("prompts with examples need retrieval_pool_path", lambda s: s.with_examples and not s.retrieval_pool_path),
    ("dynamic_fewshot needs retrieval_index_path", lambda s: s.dynamic and not s.retrieval_index_path),
    (f"dynamic_fewshot needs the method {RETRIEVAL_METHOD}", lambda s: s.dynamic and s.retrieval_method != RETRIEVAL_METHOD),
    ("unknown retrieval_rerank_method", lambda s: s.retrieval_rerank_method not in RERANK_METHODS),
    ("reranking is for dynamic_fewshot only", lambda s: not s.dynamic and s.retrieval_rerank_method != "none"),
    ("unknown fewshot_example_schema_mode", lambda s: s.fewshot_example_schema_mode not in SCHEMA_MODES),
    ("unknown fewshot_example_mode", lambda s: s.fewshot_example_mode not in EXAMPLE_MODES),
    ("example modes are for prompts with examples only", lambda s: not s.with_examples and (s.fewshot_example_schema_mode, s.fewshot_example_mode) != (SCHEMA_MODES[0], EXAMPLE_MODES[0])),
    ("retrieval_rerank_top_n is under 1", lambda s: s.retrieval_rerank_top_n < 1),
    ("fewshot_rerank_top_n is under 1", lambda s: s.fewshot_rerank_top_n is not None and s.fewshot_rerank_top_n < 1),
    ("fewshot_gate_threshold is not within -1 and 2", lambda s: s.fewshot_gate_threshold is not None and not -1 <= s.fewshot_gate_threshold <= 2),
    ("the gate is for dynamic_fewshot only", lambda s: s.fewshot_gate_enabled and not s.dynamic),
    ("unknown fewshot_gate_mode", lambda s: s.fewshot_gate_enabled and s.fewshot_gate_mode not in GATE_MODES),
    ("this gate mode needs a threshold", lambda s: s.fewshot_gate_enabled and s.fewshot_gate_mode in GATE_MODES[:2] and s.fewshot_gate_threshold is None),
    ("gate features are for weighted_score only", lambda s: s.fewshot_gate_enabled and s.fewshot_gate_mode != "weighted_score" and bool(s.fewshot_gate_features)),
    ("unknown fewshot_gate_features", lambda s: s.fewshot_gate_enabled and not set(s.fewshot_gate_features) <= set(GATE_FEATURES)),
    ("retrieval_rerank_top_n is under k", lambda s: s.dynamic and s.retrieval_rerank_method in RERANK_METHODS[1:] and s.retrieval_rerank_top_n < s.k),
    ("retrieval_structure_bonus_max is not within 0 and 0.08",
     lambda s: s.dynamic and s.retrieval_rerank_method in RERANK_METHODS[1:] and not 0 <= s.retrieval_structure_bonus_max <= 0.08),
    ("unknown extractor_mode", lambda s: s.extractor_mode not in EXTRACTORS),
]


def setting_failures(settings: RunSettings) -> list[str]:
    """Everything that is wrong with the settings."""
    return [what for what, wrong in SETTING_RULES if wrong(settings)]


def validate_settings(settings: RunSettings) -> None:
    """Raises if anything is wrong with the settings."""
    if failures := setting_failures(settings):
        raise ValueError("; ".join(failures))


def compile_only(spark: SparkSession, ddl: str, statement: str) -> str | None:
    """Why a statement does not compile against the tables of ``ddl``; null if it does.

    The tables are empty views of a session of their own; the statement is analysed
    and never run.
    """
    session = spark.newSession()
    made = []
    try:
        for text in filter(None, split_outside(ddl, ";", brackets=False)):
            table = parse_table(text)
            if table is None or not table.columns:
                return "the schema does not parse"
            session.createDataFrame([], ", ".join(f"`{c}` string" for c in table.columns)).createOrReplaceTempView(f"`{table.name}`")
            made.append(table.name)
        session.sql(to_spark_sql(statement)).schema  # noqa: B018
        return None
    except Exception as error:  # a statement's failure is a result here, whatever its kind
        return str(error).splitlines()[0]
    finally:
        for name in made:
            session.catalog.dropTempView(name)
