"""Operators for training-data pipelines, with their queries and SQL.

Nothing else in the library imports this subpackage. Importing it fills
``QUERIES`` and ``ORACLE``; ``corpus_pipeline.py`` at the repository top chains
five of the operators.
"""

from rankforge.llm import queries  # noqa: F401
from rankforge.llm.registry import ORACLE, QUERIES  # noqa: F401
