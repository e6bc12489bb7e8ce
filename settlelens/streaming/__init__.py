"""Bounded refresh and incremental delivery."""
