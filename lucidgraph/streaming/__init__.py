"""Rules over triples that keep coming. An extension: nothing in batch depends on it."""
