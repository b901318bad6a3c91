"""Readers and writers for measurements, layers, legends and run summaries."""
