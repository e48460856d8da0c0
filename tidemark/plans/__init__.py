"""Marts, served queries, the materialised mart build and the registry of queries."""
