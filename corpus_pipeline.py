"""Corpus pipeline: five stages from raw documents to token digests, see ``corpusmill.llm.pipeline``."""

from corpusmill.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
