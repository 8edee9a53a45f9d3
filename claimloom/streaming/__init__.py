"""Structured Streaming forms of the stateful parts: expiring results, running request metrics, keep-first."""
