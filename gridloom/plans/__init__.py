"""Planning over index space: regions, predicates and chunks."""
