"""crawlsight: website-audit analytics over crawl tables, as Spark jobs."""
