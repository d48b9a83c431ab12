"""The operators: reports (small tables) and transforms (fit on one aggregate, apply lazily)."""
