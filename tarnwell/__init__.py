"""tarnwell: a Spark-first engine for building, searching and measuring an evidence corpus."""
