"""Bindings to the supplied tables and the registered queries."""
