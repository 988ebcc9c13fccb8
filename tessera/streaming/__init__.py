"""Streams: an extension; profiles of event streams in event time."""
