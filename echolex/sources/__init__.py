"""Readers and writers: glossaries in text formats, pairs of transcripts, gates, licences."""
