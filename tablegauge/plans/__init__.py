"""Whole flows: structured query plans and batch runs."""
