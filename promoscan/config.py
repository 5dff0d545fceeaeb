"""Fixed values and the parameter object shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

# Column names, labels and token lists that decide results.
DATE_COLS = (
    "activation_date",
    "prize_receive_date",
    "prize_delivery_date",
    "win_date",
    "created_date",
    "modify_date",
)
USER_COLS = ("customer_id", "user_id")
USER_LIKE_COLS = ("customer_id", "user_id", "msisdn", "phone", "user_uuid", "uuid")
HISTORY_COLS = (
    "region_name",
    "win_type",
    "is_win_received",
    "is_real_prize",
    "is_point_win",
    "win_date",
    "prize_receive_date",
    "prize_delivery_date",
    "prize_id",
)
REGION_NAMES = {1: "Georgia", 2: "Armenia"}
UNKNOWN = "Unknown"

REAL_PRIZE = "real_prize"
POINTS = "points"
NO_WIN = "no_win"
WIN_TYPES = (REAL_PRIZE, POINTS, NO_WIN)

NOVICE = "Novice (1 scan)"
ACTIVE = "Active (2-5 scans)"
POWER = "Power User (6+ scans)"
ACTIVE_MAX_SCANS = 5

RECEIVED_TOKENS = ("1", "true", "yes", "y", "t")
EMPTY_PRIZE_TOKENS = ("", "null", "none", "nan")
# The documented default missing-value tokens of pandas.read_csv.
CSV_NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# What SQL reads as a flag, in any case; anything else is unknown.
TRUE_WORDS = ("t", "true", "y", "yes", "on", "1")
FALSE_WORDS = ("f", "false", "n", "no", "off", "0")

# Date forms beside ISO-8601, as datetime patterns. Forms that read the same texts are rivals: of two
# with equally many values the earlier one wins, here the one with the month first.
DATE_FORMATS = (
    "M/d/yyyy[ H:mm[:ss[.SSSSSS]]]",
    "d/M/yyyy[ H:mm[:ss[.SSSSSS]]]",
    "M.d.yyyy[ H:mm[:ss[.SSSSSS]]]",
    "d.M.yyyy[ H:mm[:ss[.SSSSSS]]]",
    "M-d-yyyy[ H:mm[:ss[.SSSSSS]]]",
    "d-M-yyyy[ H:mm[:ss[.SSSSSS]]]",
    "M/d/yyyy h:mm[:ss] a",
    "d/M/yyyy h:mm[:ss] a",
    "yyyy/M/d[ H:mm[:ss[.SSSSSS]]]",
    "yyyy.M.d[ H:mm[:ss[.SSSSSS]]]",
    "yyyyMMdd",
    "yyyyMMdd'T'HHmmss['Z']",
    "d MMM yyyy[ H:mm[:ss]]",
    "MMM d, yyyy[ H:mm[:ss]]",
)
# Numbers of so many digits are seconds, ... since 1970.
EPOCH_DIGITS = {"epoch s": 10, "epoch ms": 13, "epoch us": 16, "epoch ns": 19}
VOTE = "vote"
# The day by which scans are laid out on disk.
DAY_COL = "win_day"

DEFAULT_TZ = "Asia/Yerevan"
DEFAULT_START = "2025-09-15 00:00:00"
HISTOGRAM_BINS = 30
FORGOTTEN_DAYS = 7
LAPSED_DAYS = 15
LAPSED_REGION = 2
TOP_PENDING = 20
SKETCH_PRECISION = 12

RECEIVED_MODES = ("all", "received", "not_received")
SCOPES = ("slice", "all")
GRANULARITIES = ("Day", "Week", "Month")
SPAN_BASES = ("global", "own")


@dataclass(frozen=True)
class ScanParams:
    """The choices a dashboard user makes.

    ``start`` is the first time that counts, all by default; the dashboard itself starts at
    ``DEFAULT_START``. ``date_formats`` and ``epoch_unit`` say how date columns are read, as in ``parse_dates``.

    Times are UTC wall clocks, as text or ``datetime``. An empty ``regions``,
    ``prizes`` or ``segments`` means "no filter"; an empty ``win_types`` means "no rows".
    """

    user_col: str | None = None
    tz: str = DEFAULT_TZ
    start: object = None
    lo: object = None
    hi: object = None
    regions: tuple[str, ...] = ()
    prizes: tuple[str, ...] = ()
    segments: tuple[str, ...] = ()
    win_types: tuple[str, ...] = WIN_TYPES
    received: str = "all"
    scope: str = "slice"
    granularity: str = "Day"
    unique: bool = False
    as_of: object = None
    date_formats: object = ()
    epoch_unit: str = "ns"

    def __post_init__(self):
        check_choice("received", self.received, RECEIVED_MODES)
        check_choice("scope", self.scope, SCOPES)
        check_choice("granularity", self.granularity, GRANULARITIES)


def check_choice(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {allowed}, not {value!r}")
