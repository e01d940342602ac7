"""Types, weighted rows and small helpers that the operators share."""
