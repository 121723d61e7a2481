"""Analytics of software-change history on Spark."""
