"""Registered queries and the staged build of the site table."""
