"""gridloom: plans."""
