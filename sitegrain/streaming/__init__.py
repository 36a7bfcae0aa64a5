"""Nothing here on purpose: every operator of this library is a batch operator.

There are no event times, watermarks or keyed state in the workload. The row-level
operators (subset filters, role flags, quality, cell assignment) hold no state and so
also accept a streaming DataFrame; see ``tests/test_plans.py``.
"""
