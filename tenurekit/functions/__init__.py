"""Column-level building blocks (pure expressions, plus one small vectorised p-value helper)."""
