"""Driver-side planning: closures, paths, predicates, rewriting and checks."""
