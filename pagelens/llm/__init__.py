"""Operators of a training-data pipeline: packing, quality, privacy, near copies, extraction, chat, search, mixing, rules, language."""
