"""Readers, sinks, constant dimensions and the bindings of the test tables."""
