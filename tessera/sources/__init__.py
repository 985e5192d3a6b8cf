"""Readers, record normalisers and sinks."""
