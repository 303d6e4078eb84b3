"""Corpus, catalog, metadata, graph, retrieval, evaluation and usage jobs."""
