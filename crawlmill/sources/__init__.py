"""Sources and sinks: crawl tables, sitemaps, derived test crawls, CSV and report files, the crawl catalog."""
