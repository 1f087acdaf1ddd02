"""Feedback-loop analytics as pure DataFrame operators on Spark."""
