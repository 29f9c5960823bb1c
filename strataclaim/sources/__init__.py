"""Readers and writers of the formats that texts, graphs and vectors come in."""
