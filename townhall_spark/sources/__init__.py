"""Readers, source specifications and sinks."""
