"""Corpus preparation operators for training data, one module per operator."""
