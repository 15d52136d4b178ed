"""Relational operators of sequence mapping: sketch, index, seeds, chains, hits and alignments."""
