"""Spark-native listing resolution and corpus preparation.

The listing side lives in ``operators``, ``functions``, ``sources``, ``plans`` and ``streaming``.
"""

from bazaar.functions.score import MERGE, REVIEW, compare, identity_key
from bazaar.operators.resolve import best_match, common_contacts, parse, run_counts, score_pairs, unparsed
from bazaar.operators.resolve import resolve as assign_pending

__all__ = ["MERGE", "REVIEW", "assign_pending", "best_match", "common_contacts", "compare", "identity_key", "parse", "run_counts", "score_pairs", "unparsed"]
