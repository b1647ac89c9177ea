"""weir: crawl, document and search analytics as Spark plans."""
