"""Fixed values that results depend on; they are given, not derived."""

# Half-point spread -> (favourite, underdog) American price.
SPREAD_PRICES: dict[float, tuple[int, int]] = {
    0: (-110, -110), 0.5: (-116, -104), 1: (-122, 101), 1.5: (-128, 105), 2: (-131, 108),
    2.5: (-142, 117), 3: (-164, 135), 3.5: (-191, 156), 4: (-211, 171), 4.5: (-224, 181),
    5: (-234, 188), 5.5: (-244, 195), 6: (-261, 208), 6.5: (-282, 224), 7: (-319, 249),
    7.5: (-346, 268), 8: (-366, 282), 8.5: (-397, 302), 9: (-416, 314), 9.5: (-436, 327),
    10: (-483, 356), 10.5: (-538, 389), 11: (-567, 406), 11.5: (-646, 450), 12: (-660, 458),
    12.5: (-675, 466), 13: (-729, 494), 13.5: (-819, 539), 14: (-890, 573), 14.5: (-984, 615),
    15: (-1134, 677), 15.5: (-1197, 702), 16: (-1266, 728), 16.5: (-1267, 728), 17: (-1381, 769),
    17.5: (-1832, 906), 18: (-2149, 986), 18.5: (-2590, 1079), 19: (-3245, 1190), 19.5: (-4323, 1324),
    20: (-4679, 1359), 20.5: (-5098, 1396), 21: (-5597, 1434), 21.5: (-6000, 1500), 22: (-6500, 1600),
    22.5: (-7000, 1650), 23: (-7500, 1700), 23.5: (-8000, 1750), 24: (-8500, 1800), 24.5: (-9000, 1850),
    25: (-9500, 1900),
}
# Every half point from 25.5 to 30 has the same price.
SPREAD_PRICES.update({h / 2: (-10000, 2000) for h in range(51, 61)})
SPREAD_MAX = 30.0
PICKEM_PRICE = -110

# Team code aliases.
CODE_ALIASES = {
    "ARZ": "ARI", "BLT": "BAL", "CLV": "CLE", "HST": "HOU",
    "LAR": "LA", "STL": "LA", "SD": "LAC", "OAK": "LV",
}

# Contest calendar. From each date on, the contest week is one higher.
WEEK_CUTOFFS = {
    2020: ["2020-11-27"],
    2021: ["2021-11-26", "2021-12-26"],
    2022: ["2022-11-25", "2022-12-25"],
    2023: ["2023-11-25", "2023-12-25"],
    2024: ["2024-11-30", "2024-12-27"],
    2025: ["2025-11-29", "2025-12-26"],
    2026: ["2026-11-28", "2026-12-26"],
}

# Entries per contest year.
POOL_SIZES = {2020: 1373, 2021: 4071, 2022: 6106, 2023: 9234, 2024: 14221, 2025: 18718, 2026: 24000}

# Rating parameters.
WIN_PROB_RANGE = (0.05, 0.95)
OUTLIER_RANGE = (-4.875, 4.875)
DECAY_RATE = 0.00475
ZONE_DECAY_RATE = 0.0025
HISTORY_DAYS = 840
ZONE_HISTORY_DAYS = 3650
RATING_PASSES, SCHEDULE_MULTIPLIER = 100, 0.86
SPLIT_PASSES, SPLIT_MULTIPLIER = 50, 1.0
GAME_CAP, ZONE_GAME_CAP = 21.25, 22.0
EPA_WEIGHT, SUCCESS_WEIGHT = 0.42, 0.58
SUCCESS_TO_POINTS = 0.765
REGRESSION_RATE = 0.01
RATING_SCALE = 1.04
DEFAULT_VOLUME, VOLUME_DIVISOR = 40.0, 2.1
MIN_VOLUME = 50
MIN_WEIGHTED_PLAYS = 30
HOME_EPA = 0.04
EARTH_MILES = 3956
SHRINK_PRIOR = 50

# Upper bounds and labels of the outcome-variance levels.
VARIANCE_LABELS = ["Low", "Med-Low", "Medium", "Med-High", "High"]
VARIANCE_BOUNDS_COMBINED = [160, 170, 180, 195]
VARIANCE_BOUNDS_SINGLE = [70, 85, 100, 115]

# Fallbacks of the play profiles.
PROFILE_DEFAULTS = {
    "run_mu": 3.5, "run_sigma": 3.0, "run_fumble": 0.01,
    "sack": 0.07, "complete": 0.6, "intercept": 0.03, "pass_fumble": 0.01, "pass_mu": 7.0, "pass_sigma": 5.0,
    "completion_mu": 10.0, "completion_sigma": 5.0,
    "interference_share": 0.1, "major_share": 0.15, "interference_mu": 15.0, "interference_std": 10.0,
    "net_punt": 40.0, "longest_made": 50.0, "short_acc": 0.98, "mid_acc": 0.85, "long_acc": 0.65,
    "breakaway": 0.035,
}
BREAKAWAY_YARDS = 15

# Several picks in one week lower the survival rate.
MULTI_PICK_SURVIVAL = {1: 1.0, 2: 0.65, 3: 0.35}

# Matchup categories of the upset features.
MATCHUP_CATEGORIES = [
    "Overall", "Run", "Pass", "Pass_Deep", "Pass_Short", "Redzone", "3rd_Down", "1st_Down",
    "Play_Action", "Quick_Game_Proxy", "Under_Pressure",
]
