"""Fixed values of the hazard index and of its climatologies."""

EARTH_RADIUS_KM = 6371.0088
EARTH_RADIUS_CASES_KM = 6371.0
NAUTICAL_MILE_KM = 1.852
KNOT_MS = 0.514444
QUADRANTS = ("rne", "rse", "rsw", "rnw")
SYNOPTIC_HOURS = (0, 6, 12, 18)
STEP_SECONDS = 6 * 3600

TROPICAL_STORM_KT = 34.0
R34_MS = TROPICAL_STORM_KT * KNOT_MS
OUTER_MS = 2.0
TAIL_END_KT = 12.0 / KNOT_MS
EPSILON = 1e-6
#: Wind (kt) and hazard at it; linear in between.
WIND_NODES = ((34.0, 0.2), (64.0, 0.4), (83.0, 0.6), (96.0, 0.8), (137.0, 1.0))
#: Hazard classes 0..5: upper bounds of classes 1..5.
CLASS_BOUNDS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
CLASS_LABELS = ("0 No hazard / exterior", "1 Very low", "2 Low", "3 Moderate", "4 High", "5 Extreme")

#: Rain hazard: nodes, hazards at 0 mm and at the nodes without and with escalation, and the escalating ranges.
RAIN_NODES = ("Q75", "Q90", "Q95")
RAIN_BASE = (0.0, 0.0, 0.25, 1.0)
RAIN_ESCALATED = (0.0, 0.0, 0.8, 1.0)
RAIN_ESCALATION = {"r24": ("Q90", "Q95"), "a72": (None, "Q75")}

WET_MM = 1.0
QUANTILES = (0.75, 0.9, 0.95, 0.99, 0.999)
MIN_EXCEEDANCES = 10
ABSOLUTE_THRESHOLDS_MM = {6: (10, 20, 35, 60), 24: (25, 50, 100, 150), 72: (50, 100, 200, 300)}

SEPARATION_HOURS = {6: 48, 24: 48, 72: 96}
PEAKS_A_SEASON = 3
MIN_VALID_FRACTION = 0.9
GEV_MIN_SEASONS = 15
GPD_MIN_EXCESSES = 20
SHAPE_BOUNDS = (-0.5, 0.5)
RETURN_PERIODS = (2.0, 5.0, 10.0, 25.0, 50.0, 100.0)
RECURRENCES = (0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 25.0, 50.0, 100.0)

BASE_RAMP = (0, 1, 2, 3, 4, 4)
ESCALATED_CLASSES = (3,)
ESCALATED_LEVEL = 4
LEAD_LEVELS = (2, 3, 4, 5)
LEAD_WINDOW_HOURS = 120
