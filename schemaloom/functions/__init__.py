"""Column functions: text clean-up, group keys, arrays and JSON, scores, predicates, types."""
