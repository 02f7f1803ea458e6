"""Part of lexispark: operators."""
