"""Readers and writers of timed text, silence logs and transcripts."""
