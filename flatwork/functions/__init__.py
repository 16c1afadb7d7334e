"""Column-level helpers: coercion, statistics, calculated fields and feature rules."""
