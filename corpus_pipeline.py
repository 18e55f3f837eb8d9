"""The corpus pipeline of the subpackage llm: STAGES in their order, run(spark, sf_dir), and its SQL (none)."""

from palimpsest.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, dedup, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "dedup", "run"]
