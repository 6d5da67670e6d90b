"""Runnable jobs over the library; each is a function of a session and a command line."""
