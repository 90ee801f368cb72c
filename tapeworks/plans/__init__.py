"""Plan shapes shared by the operators: ordered series, top-k, exact medians."""
