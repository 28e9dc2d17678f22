"""Table operators: filters, joins, aggregations, ranking, evaluation, storage zones."""
