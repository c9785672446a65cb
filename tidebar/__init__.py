"""Rule-based time-series decisions as Spark plans."""
