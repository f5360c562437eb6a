"""DataFrame operators: filters, joins, aggregates, time-series windows, graphs, models and ordered folds."""
