"""Operators for large training-data pipelines: filtering, deduplication, tokenizing, archiving, search and scoring.

Nothing outside this folder imports it.  Every operator takes DataFrames and returns DataFrames; numpy, Arrow and
small Python helpers run inside tasks only.
"""
