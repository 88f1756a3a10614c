"""gridloom: streaming."""
