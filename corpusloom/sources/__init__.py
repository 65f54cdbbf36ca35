"""Readers and writers of text, tables, rules and configuration."""
