"""Part of lexispark: functions."""
