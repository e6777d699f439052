"""Part of quillspark: plans."""
