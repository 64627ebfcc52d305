"""Readers and writers for feeds, subscription lists, tables and reports."""
