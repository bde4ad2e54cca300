"""Operators for training-data pipelines: deduplication, archives, decontamination, classifiers, sharding, secrets."""
