"""Part of tidewater."""
