"""Whole jobs: summaries, corpora and experiments over many networks."""
