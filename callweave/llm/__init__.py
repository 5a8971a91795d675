"""Corpus preparation for language-model training; nothing outside imports it."""
