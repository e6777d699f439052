"""Part of quillspark: functions."""
