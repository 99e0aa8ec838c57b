"""Audit-event analytics on Spark: mergeable summaries, roll-ups, compliance reports."""
