"""Registered queries and the end-to-end pipeline."""
