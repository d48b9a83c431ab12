"""Running the lazy applies and stateless operators on file streams."""

from .files import read_stream, run_available, stream_duplicates_dropped

__all__ = ["read_stream", "run_available", "stream_duplicates_dropped"]
