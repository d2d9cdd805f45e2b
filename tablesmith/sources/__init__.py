"""Definition files in, record files out."""
