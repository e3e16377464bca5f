"""Fixed values of the incident domain. Results depend on every one of them."""

# Places and distances.
CITY_CENTRE = (12.9716, 77.5946)
EARTH_RADIUS_KM = 6371.0
LOCAL_ZONE = "Asia/Kolkata"

# Spellings.
NULL_LITERAL = "NULL"
NO_CORRIDOR = "Non-corridor"
OTHER_LEVEL = "__other__"
CAUSE_SYNONYMS = {
    "debris": "debris",
    "fog / low visibility": "fog",
    "test_demo": "others",
}
GATHERING_CAUSES = ["public_event", "procession", "vip_movement", "protest"]
BARRICADE_CAUSES = [
    "public_event", "procession", "vip_movement", "protest", "construction",
    "tree_fall", "accident", "water_logging", "debris",
]
SURVIVAL_CAUSES = [
    "vehicle_breakdown", "accident", "construction", "water_logging", "tree_fall",
    "public_event", "procession", "vip_movement", "pot_holes",
]

# Clearance gate and horizon in minutes.
MAX_CLEARANCE_MIN = 1440

# Causal neighbourhood.
DENSITY_RADII_KM = (1.0, 3.0)
KERNEL_CUTOFF_KM = 4.0
NARROW_BANDWIDTH_KM = 1.0
WIDE_BANDWIDTH_KM = 1.5
RECENCY_RADIUS_KM = 1.0
RECENCY_CAP_HOURS = 72.0

# Panel shape.
PANEL_LAGS = [1, 2, 3, 24, 168]
PANEL_ROLLS = [24, 168]
SPATIAL_LAGS = [1, 24]
SEASON = 168
NEIGHBOURS = 5
MIN_CENTROID_KM = 0.1

# Feature groups in their published order.
FEATURE_GROUPS = {
    "temporal": ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "dow", "is_weekend",
                 "month", "is_peak", "daypart"],
    "spatial_coord": ["lat", "lon", "dist_center_km"],
    "density_kde": ["hist_density_1km", "hist_density_3km", "kde_intensity",
                    "kde_gathering", "kde_accident", "kde_closure"],
    "recency": ["hrs_since_nearby"],
    "cat_core": ["event_type", "event_cause", "corridor", "veh_type", "zone",
                 "authenticated", "is_gathering", "is_corridor"],
    "cat_extra": ["junction", "police_station", "pin", "cause_corridor"],
    "text": ["has_desc", "desc_len", "desc_nonascii"],
    "target_enc": ["corridor_event_rate"],
}
FEATURES = [name for group in FEATURE_GROUPS.values() for name in group]
CLASSIFIER_FEATURES = (FEATURE_GROUPS["cat_core"] + FEATURE_GROUPS["spatial_coord"]
                       + FEATURE_GROUPS["text"])
CATEGORICAL_FEATURES = [
    "event_type", "event_cause", "corridor", "veh_type", "zone", "authenticated",
    "is_peak", "daypart", "junction", "police_station", "pin", "cause_corridor",
]
PANEL_FEATURES = (["hour", "dow", "is_weekend", "hour_sin", "hour_cos"]
                  + [f"lag_{n}" for n in PANEL_LAGS]
                  + [f"roll_{n}" for n in PANEL_ROLLS]
                  + [f"slag_{n}" for n in SPATIAL_LAGS])

# Severity formula and deployment rules.
SEVERITY_WEIGHTS = {"closure": 0.55, "duration": 0.35, "cause": 0.10}
FORMER_WEIGHTS = {"closure": 0.55, "priority": 0.30, "duration": 0.15}
SEVERITY_CUTS = {"Moderate": 0.10, "High": 0.20, "Critical": 0.46}
DEFAULT_CLEARANCE_MIN = 60.0
FULL_CLEARANCE_MIN = 240.0
TIERS = ["Low", "Moderate", "High", "Critical"]
TIER_QUANTILES = [0.50, 0.82, 0.97]
OFFICERS = {"Low": 1, "Moderate": 2, "High": 4, "Critical": 7}
BARRICADES = {"Moderate": 2, "High": 4, "Critical": 8}
TIER_COLOURS = {"Critical": "#dc2626", "High": "#ea580c", "Moderate": "#ca8a04", "Low": "#16a34a"}
DIVERSION_FULL = "Full diversion: close affected stretch, signed detour + upstream signal hold"
DIVERSION_PARTIAL = "Partial diversion: lane drop, merge control at nearest junction"
DIVERSION_ADVISORY = "Advisory diversion: VMS warning, encourage alternate route"
DIVERSION_NONE = "No diversion: monitor and keep lane open"
