"""Readers: graph tables, derived graphs, diffs, logs and snapshots."""
