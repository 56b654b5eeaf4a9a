"""dsengine: automated table profiling, cleaning, exploration, modelling and
scoring expressed as PySpark DataFrame / SQL / ML jobs.

Every operator takes a DataFrame and returns a DataFrame (plus, for the
multi-step operators, a small report DataFrame). Statistics that steer a
later step are computed by aggregate jobs and reach the rows as literals.
"""

__version__ = "0.1.0"
