"""The registered queries, each with the SQL that states its result."""

from shotweave.workloads import formats, graph, instructions, labelling, scoring, search, splitting  # noqa: F401
from shotweave.workloads.registry import QUERIES, SQL  # noqa: F401
