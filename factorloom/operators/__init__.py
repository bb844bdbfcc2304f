"""DataFrame operators: reshaping, calendar, windows, sorts, legs, inference."""
