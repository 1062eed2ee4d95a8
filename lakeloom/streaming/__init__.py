"""Structured Streaming forms of the stateful operators, with the batch results as their tests."""
