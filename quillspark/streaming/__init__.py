"""Part of quillspark: streaming."""
