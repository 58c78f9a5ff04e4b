"""Operators for corpora that language models are trained on; nothing outside imports this subpackage."""
