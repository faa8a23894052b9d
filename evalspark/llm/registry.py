"""All queries of this folder, and the pipeline at the repository's top."""

from corpus_pipeline import ORACLE_SQL, run
from evalspark.llm.queries import Q as _QUERIES

Q = _QUERIES | {"pipeline": (run, ORACLE_SQL)}
