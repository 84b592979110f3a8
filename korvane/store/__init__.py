"""Stored tables that later runs bring up to date, and the services on top of them."""
