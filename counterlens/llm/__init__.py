"""Operators for large training corpora: tokenising, deduplication, mixing,
sharding, page extraction, language identification, vector search and media
columns. Nothing outside this subpackage imports it."""
