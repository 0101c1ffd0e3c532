"""Column functions: numeric, calendar, geographic, text and encoding helpers."""
