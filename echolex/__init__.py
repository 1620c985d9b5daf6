"""Phonetic-constraint transcript analytics on Spark."""
