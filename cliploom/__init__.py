"""Cliploom: finding, ranking and auditing short clips over a catalogue of transcripts, on Spark."""
