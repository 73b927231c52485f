"""Streams of mutations into vector tables."""
