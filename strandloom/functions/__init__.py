"""Scalar and array functions over sequences, alignments and hits."""
