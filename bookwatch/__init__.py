"""bookwatch: reservation-risk analytics expressed as Spark DataFrame plans.

Every public operator takes and returns a lazy ``DataFrame`` (or a ``Column``
for row-wise rules), so Catalyst sees one plan per report and row-level work
never leaves the executors.
"""

__version__ = "0.1.0"
