"""Readers, writers, table schemas, fixed vocabularies and the views the checks run on."""
