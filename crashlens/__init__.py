"""Crash-triage and time-to-event analytics as DataFrame operators."""
