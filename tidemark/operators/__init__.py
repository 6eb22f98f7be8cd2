"""DataFrame operators: split series, as-of join, dedup, reshape, scoring, modelling, reports."""
