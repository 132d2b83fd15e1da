"""Jobs that run operators from files to files."""
