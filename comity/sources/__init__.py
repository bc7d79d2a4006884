"""Readers, thread flattening and sinks."""
