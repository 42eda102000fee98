"""Incremental operators: corpus index, hook logs, budget alerts, window replacement, publishing."""
