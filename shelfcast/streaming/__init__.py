"""Structured Streaming entry points.

The forecasting workload itself is batch only. The one streaming use here is
the batch scorer applied to sales files as they arrive: the same enrichment,
normalisation and encoding as the batch test set (stream-static joins to the
dimensions and the training statistics), then a fitted model."""

from shelfcast.streaming.score import scoring_stream, start_scoring

__all__ = ["scoring_stream", "start_scoring"]
