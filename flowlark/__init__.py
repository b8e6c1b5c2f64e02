"""Network-traffic detection on Spark: sources, features, rules, models, fusion and evaluation as DataFrame jobs."""
