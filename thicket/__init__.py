"""Knowledge-graph and operational analytics as Spark DataFrame operators."""
