"""Reusable plan shapes: ordered scans, guarded broadcasts, fixture derivations."""
