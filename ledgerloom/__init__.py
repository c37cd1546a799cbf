"""ledgerloom: sales-file onboarding on Spark.

Screens incoming files, standardizes headers, infers column types, profiles
columns, runs graded data-quality rules, fills gaps, conforms rows to a fixed
sales schema, and answers list / lookup / summary queries over the result.
Every step is a DataFrame -> DataFrame function built on Spark expressions.
"""

from ledgerloom.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
