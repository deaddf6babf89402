"""The query catalogue: each operator of the dialect as a statement over the shared tables."""
