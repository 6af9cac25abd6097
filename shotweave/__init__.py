"""Few-shot instruction datasets and fingerprint similarity, as Spark DataFrame jobs."""
