"""Functions over query logs."""
