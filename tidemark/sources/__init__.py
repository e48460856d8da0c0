"""Readers, the symbol dimension, the fixture mapping of the driver tables, sources and sinks."""
