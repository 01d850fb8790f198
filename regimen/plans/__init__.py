"""Registered queries and the views that they run on."""
