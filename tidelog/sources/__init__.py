"""Tables and files as event tables."""
