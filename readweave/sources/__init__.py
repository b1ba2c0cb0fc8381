"""Readers and writers for the text, sequence and alignment formats of the pipeline."""
