"""Operators on reads, signal profiles and regions."""
