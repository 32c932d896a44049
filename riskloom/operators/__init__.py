"""Operators on DataFrames: features, validation, graph, embeddings, models, ranking."""
