"""Operators of a training-data pipeline: near-dedup, language id, repeat
removal, top-k search, language-model and quality scoring, secret scans,
benchmark decontamination, sequence packing and URL rules.

Nothing else in the library imports this subpackage."""
