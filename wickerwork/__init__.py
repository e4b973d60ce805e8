"""wickerwork: basket, catalogue, outcome and price analytics as Spark DataFrame jobs."""
