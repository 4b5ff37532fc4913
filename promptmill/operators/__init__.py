"""DataFrame operators: filters, mapping, tokenising, order, batching, joins, metrics."""
