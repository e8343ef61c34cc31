"""Streaming use of the stateless operators (readStream -> column work -> writeStream)."""
