"""Operators over conversations: parsing, revisions, datasets, evaluation, panels, transcripts."""
