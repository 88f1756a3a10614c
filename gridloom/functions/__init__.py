"""gridloom: functions."""
