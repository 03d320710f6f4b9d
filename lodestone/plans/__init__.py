"""Index store and its relational plans."""
