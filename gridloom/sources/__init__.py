"""gridloom: sources."""
