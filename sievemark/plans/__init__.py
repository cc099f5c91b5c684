"""Definitions, runs, scheduling and the registered queries."""
