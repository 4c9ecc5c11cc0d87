"""All registered queries of the subpackage."""

from . import bytebpe, decontaminate, jaccard, licences, neardup, pieces, preference, prefixtrie, quality, secrets, tokenfiles, toxicity, variants  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
