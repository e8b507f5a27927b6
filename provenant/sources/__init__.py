"""Readers and writers of the corpus, its snapshots and its evaluation files."""
