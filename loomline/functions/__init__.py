"""Column expressions: types, names, similarity and scores."""
