"""DataFrame operators: spatial joins, sequences, aggregates, graphs and geometry rewrites."""
