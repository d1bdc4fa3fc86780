"""Column expressions: text cleaning, vectors, ordering, names."""
