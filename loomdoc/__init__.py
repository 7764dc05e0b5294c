"""loomdoc: a Spark-first engine for versioned documentation corpora."""
