"""Streaming use of the stateless text functions.

The reference processes closed files only (no watermark, window or state), so
there is no streaming operator to rebuild.  The Column -> Column text
functions hold no state, so they run unchanged on a streaming DataFrame;
`text_stream` shows the pattern with a file source and an `availableNow`
trigger whose checkpoint lives in the shared checkpoint folder.
"""

from textloom.streaming.text_stream import token_counts_stream, write_available_now

__all__ = ["token_counts_stream", "write_available_now"]
