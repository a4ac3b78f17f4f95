"""Training-data operators: ten corpus-scale operations over the documents, labels and embeddings tables."""
