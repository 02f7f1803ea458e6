"""Part of lexispark: streaming."""
