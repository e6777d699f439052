"""Part of quillspark: operators."""
