"""Streams: files as they arrive, and windows over events; a streamed result equals the batch result."""
