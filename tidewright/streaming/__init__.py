"""Structured Streaming forms of candles, sessions and running drawdowns."""
