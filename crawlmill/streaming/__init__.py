"""Structured Streaming: incremental counts over a growing crawl."""
