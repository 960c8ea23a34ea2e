"""Column functions and predicates; no Python runs on the executors for any of them."""
