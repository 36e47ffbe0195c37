"""Registered queries, grouped as in the operator inventory."""
