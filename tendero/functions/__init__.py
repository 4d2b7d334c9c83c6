"""Column expressions: predicates, measures, labels and text helpers."""
