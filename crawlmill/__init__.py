"""Crawl analytics on Spark: page facts, named views, issue rules, graph passes and crawl comparison as DataFrame plans."""
