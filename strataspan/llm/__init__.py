"""Operators of a training-data pipeline: search, mixing, near and exact duplicates, tokens, chat, quality, packing, lines, secrets."""
