"""Network-flow preparation, splitting and judging on Spark."""
