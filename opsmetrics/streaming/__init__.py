"""The long-running watches as Structured Streaming queries."""
