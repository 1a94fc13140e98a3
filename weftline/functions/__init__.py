"""Expressions: Column to Column."""
