"""flightlens: flight-delay analytics as DataFrame operators on Spark.

Raw flight, airport, aircraft and storm files become typed tables; storms are
matched to airports by distance; the tables feed delay and cancellation views,
which are stored as keyed rows and read back as series and matrices.
"""

from flightlens.session import build_session, clear_scratch, pin_utc, scratch_dir

__all__ = ["build_session", "clear_scratch", "pin_utc", "scratch_dir"]
