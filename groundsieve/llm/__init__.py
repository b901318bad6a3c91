"""Training-data operators on document tables. Nothing outside this subpackage imports it."""
