"""Siftloom: corpus curation, selection and evaluation operators, declared as Spark plans."""
