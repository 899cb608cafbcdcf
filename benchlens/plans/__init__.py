"""End-to-end plans for the three entry points: report, sweep, runs."""

from . import report, runs, sweep  # noqa: F401
