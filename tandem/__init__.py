"""tandem: season-wide event-sequence valuation on Spark DataFrames.

Check event data, mark segments, label each event by what happens next,
train classifiers for the labels, turn probability changes into values, and
credit consecutive actors of one side as pairs, for all sequences at once.
"""

from tandem.config import REFERENCE_ROLES, TABLE_ROLES, Roles

__all__ = ["Roles", "REFERENCE_ROLES", "TABLE_ROLES"]
