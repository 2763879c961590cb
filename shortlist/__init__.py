"""Spark jobs for exemplar retrieval, reranking data and their evaluation."""
