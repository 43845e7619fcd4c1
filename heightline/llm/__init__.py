"""Training-data operators: ten methods for corpora, media, vectors and URLs."""
