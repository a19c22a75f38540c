"""Where graphs come from: mappings of labels and relationship types to tables."""
