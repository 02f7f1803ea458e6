"""Part of lexispark: sources."""
