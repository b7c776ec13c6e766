"""DataFrame-to-DataFrame operators: audit, cleaning, analysis, dashboard tables."""
