"""Article files, landed feeds and the stored article table."""
