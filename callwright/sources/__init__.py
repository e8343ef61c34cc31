"""Readers, rule/spec assets and sinks."""
