"""Continuous inserts and workload counts with Structured Streaming."""
