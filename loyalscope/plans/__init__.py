"""Complete queries: ``core`` (the six reference queries), ``extended`` (the documented extras),
``report`` (all six from one pass), ``registry`` and ``oracle`` (the driver contract)."""
