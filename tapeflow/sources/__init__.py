"""Readers and writers of tapes and logs."""
