"""Physical-plan helpers: skew handling, distributed ranking, lineage cuts, end-to-end jobs."""
