"""The time-driven jobs as Structured Streaming, on the batch operators' own code."""
