"""Readers and writers: triples, entity labels, rules, dictionaries, vectors, models, metrics."""
