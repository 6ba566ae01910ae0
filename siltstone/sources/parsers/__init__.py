"""Parsers: bytes of one file -> blocks. Each is a plain function that runs in an Arrow task."""
