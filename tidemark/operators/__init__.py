"""DataFrame operators: staging, validation, news enrichment, search cache, quality and metrics."""
