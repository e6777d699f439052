"""Part of quillspark: sources."""
