"""Every query of the library by name, with its SQL."""

from quillspark.queries import analytics, derivation, evaluation, maintenance, mail, retrieval, sources, streams, transcripts  # noqa: F401
from quillspark.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
