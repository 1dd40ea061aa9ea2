"""Corpus preparation for training data: near copies, shards, licences, quality, text, encoding."""
