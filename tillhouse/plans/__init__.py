"""The pipeline's tables, checks and publication."""
