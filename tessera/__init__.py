"""A Spark-first relational, vector and corpus analytics engine."""
