"""Readers, and the bindings of the driver's tables to traces, events, pixels and recordings."""
