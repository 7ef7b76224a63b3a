"""Streaming forms of the stateless operators (parse, score)."""

from glmframe.streaming.scoring import ScoringCounters, read_matrix_stream, start_keyed_scoring

__all__ = ["ScoringCounters", "read_matrix_stream", "start_keyed_scoring"]
