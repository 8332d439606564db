"""Functions over columns: text scoring and embeddings."""
