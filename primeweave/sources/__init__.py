"""Codecs, containers, Spark data sources and sinks."""
