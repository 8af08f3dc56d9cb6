"""Stateless scoring of streaming DataFrames (scaler transform, entropy score, batch scorer)."""

from kindling.streaming.scoring import score_stream, start_scoring

__all__ = ["score_stream", "start_scoring"]
