"""Readers and writers for case stores, sheets, logs, reports and document folders."""
