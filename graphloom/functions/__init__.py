"""Column functions with the semantics of graph query languages."""
