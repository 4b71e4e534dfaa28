"""Registered queries, their SQL twins and the binding to the test tables."""
