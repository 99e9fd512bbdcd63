"""Operators for preparing training text: filtering, mixing, scrubbing, encoding and scoring documents."""
