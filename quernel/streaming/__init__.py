"""Engine queries over Structured Streaming sources.

A stream attached as a table is read by the same SELECT text as a stored one; grouping by time windows needs a watermark.
"""

from quernel.streaming.tables import attach_stream, start

__all__ = ["attach_stream", "start"]
