"""Corpus-preparation operators for training data: sharding, deduplication,
mixing, filters, search, archives and classifiers.  Nothing outside this
subpackage imports it."""
