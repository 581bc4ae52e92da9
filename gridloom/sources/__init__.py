"""Readers that flatten documents and captures into rows, and sinks."""
