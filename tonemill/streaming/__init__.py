"""Streaming: the stateless labelers over a file stream."""
