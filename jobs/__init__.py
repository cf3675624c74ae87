"""Runnable jobs: each is a function that takes a session, and a command line over a small config file."""
