"""The SQL front end: one INSERT INTO sink(...) query."""
