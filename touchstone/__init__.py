"""Touchstone: evaluation, audit and monitoring of media-forensics detectors on Spark."""

__version__ = "0.1.0"
