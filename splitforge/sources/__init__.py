"""Reading of files, manifests and tables, and writing of results."""
