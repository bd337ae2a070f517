"""Code tables of the source data."""

# Cancellation reasons by code.
CANCELLATION_REASONS = {
    "A": "Carrier",
    "B": "Weather",
    "C": "National Air System",
    "D": "Security",
}

# Registry aircraft types by code.
AIRCRAFT_TYPES = {
    "1": "Glider",
    "2": "Balloon",
    "3": "Blimp/Dirigible",
    "4": "Fixed wing single engine",
    "5": "Fixed wing multi engine",
    "6": "Rotorcraft",
    "7": "Weight-shift-control",
    "8": "Powered Parachute",
    "9": "Gyroplane",
    "H": "Hybrid Lift",
    "O": "Other",
}

# Registry engine types by code.
ENGINE_TYPES = {
    "0": "None",
    "1": "Reciprocating",
    "2": "Turbo-prop",
    "3": "Turbo-shaft",
    "4": "Turbo-jet",
    "5": "Turbo-fan",
    "6": "Ramjet",
    "7": "2 Cycle",
    "8": "4 Cycle",
    "9": "Unknown",
    "10": "Electric",
    "11": "Rotary",
}

# Storm event types by category. Also the list of events kept.
STORM_CATEGORIES = {
    0: ["Tornado", "Funnel Cloud"],
    1: ["Hail", "Heavy Rain", "Thunderstorm Wind"],
    2: ["Hurricane", "Marine Hurricane/Typhoon", "Tropical Storm"],
    3: ["Winter Storm", "Blizzard", "Heavy Snow", "Ice Storm"],
    4: ["Dust Storm", "Dense Fog"],
}
EVENT_CATEGORY = {event: cat for cat, events in STORM_CATEGORIES.items() for event in events}

# Aircraft age buckets, both ends inclusive, and the display order.
AGE_BUCKETS = [("0-5", 0, 5), ("6-10", 6, 10), ("11-20", 11, 20), (">20", 21, None)]
AGE_UNKNOWN = "unknown"
AGE_ORDER = [name for name, _, _ in AGE_BUCKETS] + [AGE_UNKNOWN]
