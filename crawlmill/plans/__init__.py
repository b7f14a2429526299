"""Whole queries: the named views, the issue rules, fused counts and the report."""
