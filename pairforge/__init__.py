"""pairforge: find, prune, split, render and score near-identical record pairs on Spark.

Every stage is ``DataFrame -> DataFrame``; Catalyst chooses the physical plan.  The subpackage ``llm`` holds the
training-data operators and is optional: nothing outside it imports it.
"""

__version__ = "0.1.0"
