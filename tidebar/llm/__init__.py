"""Training-data operators: ten numbered operators over documents and embeddings."""
