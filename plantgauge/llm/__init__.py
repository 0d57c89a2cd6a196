"""Operators that prepare training data: runs, cross-split overlap, exact percentiles, tokens, leaks, abuse."""
