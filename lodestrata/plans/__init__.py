"""Helpers that shape physical plans: lineage cuts, bounded broadcasts, distributed ranking."""
