"""Readers and writers: document folders, tables, reports and the score log."""
