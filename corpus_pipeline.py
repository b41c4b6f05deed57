"""The corpus pipeline: language, near duplicates, benchmark passages, mixture, shards."""

from plankton.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
