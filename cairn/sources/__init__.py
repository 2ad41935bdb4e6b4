"""Scans and sinks: text, whole files, binary files, driver logs, the
knowledge-base sheet, cluster listings and message envelopes."""
