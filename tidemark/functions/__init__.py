"""Scalar expressions over entity ids, topics, offsets and coordinates."""
