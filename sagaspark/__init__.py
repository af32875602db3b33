"""sagaspark: a Spark-first engine for versioned, evidence-backed knowledge drawn from long texts."""
