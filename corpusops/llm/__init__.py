"""Training-data operators over text, vectors and conversations. Nothing outside this package imports it."""
