"""Zephyria: climate and human-health-risk analytics as Spark jobs.

Every public function takes and returns either a :class:`Column` or a
:class:`DataFrame`; nothing is evaluated until a sink or an action.
"""

__version__ = "0.1.0"
