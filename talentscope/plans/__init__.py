"""End-to-end pipelines, the named query catalogue and its SQL oracle."""
