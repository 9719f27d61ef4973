"""Readers of event files, group lists and artifact folders."""
