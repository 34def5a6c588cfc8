"""Tidepool: multi-stage document retrieval and context assembly as Spark plans."""
