"""Text and session repetition mining on Spark."""
