"""DataFrame operators: cohorts, summaries, quantiles, curves, zones, trees."""
