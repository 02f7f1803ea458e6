"""Part of lexispark: plans."""
