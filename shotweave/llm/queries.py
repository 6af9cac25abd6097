"""All queries of the subpackage."""

from shotweave.llm import (bpe, collocations, dedup_exact, dedup_near, dedup_substring, lm, merkle, neighbours, packing, pii, quality,  # noqa: F401
                           ranked, toxicity)
from shotweave.llm.registry import QUERIES, SQL  # noqa: F401
