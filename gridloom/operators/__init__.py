"""gridloom: operators."""
