"""Column roles and domain constants.

Every operator takes a :class:`Roles` value instead of hard-coded column
names or ids, so the same code runs on the nested event files of a football
season (``REFERENCE_ROLES``) and on the driver's flat ``events`` table
(``TABLE_ROLES``, see ``tandem.sources.bind``).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

# ---------------------------------------------------------------------------
# Fixed values of the event-data domain. They must equal the original
# analytic's constants for results to agree; do not edit.
# Defensive actions are pressure, block, duel, ball recovery, clearance and
# interception; a dispossession counts as defence for the other side; the half
# marker has an index above MARKER_MIN_INDEX; a window is the current event and
# the next LOOKAHEAD_K.
# ---------------------------------------------------------------------------
VALID_TYPE_IDS = (2, 3, 4, 5, 6, 8, 9, 10, 14, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25,
                  26, 27, 28, 30, 33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43)
ROSTER_EXEMPT_TYPE_IDS = (5, 18, 34, 35, 36, 41)
DEFENCE_TYPE_IDS = (2, 4, 6, 9, 10, 17)
DISPOSSESSED_TYPE_IDS = (3,)
GOAL_OUTCOME_ID = 97
OWN_GOAL_TYPE_ID = 25
HALF_START_TYPE_ID = 18
MARKER_MIN_INDEX = 5
FOCUS_TEAM_ID = 217
LOOKAHEAD_K = 5
X_RANGE = (-1.0, 121.0)
Y_RANGE = (-1.0, 81.0)

# Rows per sequence chunk. A match (or any ordered group) is cut into chunks
# of at most this many order-key units so that no window partition holds a
# whole hot group; see tandem.operators.sequence.
DEFAULT_CHUNK_WIDTH = 1 << 17


@dataclass(frozen=True)
class Roles:
    """Names of the canonical event columns plus the domain rules.

    ``goal_expr`` and ``marker_expr`` are Spark SQL boolean expressions over the
    canonical columns: a goal credited to the side of the event, and a row that
    opens the second segment (half).
    """

    match: str = "match_id"
    index: str = "index"
    type: str = "type"
    player: str = "player_id"
    player_name: str = "player_name"
    team: str = "team"
    holder: str = "possession_team"
    location: str = "location"
    x: str = "x"
    y: str = "y"
    time_text: str = "timestamp"
    substitute: str = "substitute"
    focus: Any = FOCUS_TEAM_ID
    k: int = LOOKAHEAD_K
    valid_types: tuple = VALID_TYPE_IDS
    roster_exempt_types: tuple = ROSTER_EXEMPT_TYPE_IDS
    defence_types: tuple = DEFENCE_TYPE_IDS
    dispossessed_types: tuple = DISPOSSESSED_TYPE_IDS
    goal_expr: str = f"shot_outcome = {GOAL_OUTCOME_ID} OR type = {OWN_GOAL_TYPE_ID}"
    marker_expr: str = f"type = {HALF_START_TYPE_ID}"
    marker_min_index: int = MARKER_MIN_INDEX
    x_range: tuple = X_RANGE
    y_range: tuple = Y_RANGE
    chunk_width: int = DEFAULT_CHUNK_WIDTH
    labels: tuple = field(default=("label_goal", "label_concede", "label_keep", "label_lose"))

    def with_(self, **changes) -> "Roles":
        return replace(self, **changes)


REFERENCE_ROLES = Roles()

# Binding of the driver's flat tables to the roles above (FIXTURES.md section 2):
# side = user_id % 2 and holder = k % 2 with focus side 1; a goal is a purchase
# worth more than 60, an own goal for the side a signup worth more than 250; the
# half marker is a signup at or after 12:00; defence is error/signup by the side
# itself or a view by the other side; valid types click, view, purchase; no type
# is exempt from the roster check.
TABLE_ROLES = Roles(
    focus=1,
    valid_types=("click", "view", "purchase"),
    roster_exempt_types=(),
    defence_types=("error", "signup"),
    dispossessed_types=("view",),
    goal_expr="(type = 'purchase' AND x > 60) OR (type = 'signup' AND x > 250)",
    marker_expr="type = 'signup' AND TRY_CAST(substring(timestamp, 1, 2) AS INT) >= 12",
)
