"""Registered queries on the shared test tables and their SQL counterparts."""
