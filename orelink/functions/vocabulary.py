"""Vocabularies, patterns and thresholds that results depend on."""

# Whole-token expansions of abbreviations, and spellings of units.
ABBREVIATIONS = {
    "BRG": "BEARING", "BRGS": "BEARINGS", "BEAR": "BEARING", "VLV": "VALVE", "VLVS": "VALVES", "MTR": "MOTOR", "MOT": "MOTOR", "PMP": "PUMP", "PMPS": "PUMPS",
    "CENT": "CENTRIFUGAL", "IND": "INDUCTION", "BLK": "BLOCK", "1PH": "SINGLE_PHASE", "3PH": "THREE_PHASE", "SS": "STAINLESS_STEEL", "MS": "MILD_STEEL", "CI": "CAST_IRON",
}
UNITS = {
    "VOLT": "V", "VOLTS": "V", "WATT": "W", "WATTS": "W", "KILOWATT": "KW", "KILOWATTS": "KW", "HERTZ": "HZ", "HZ": "HZ", "AMP": "A", "AMPS": "A", "AMPERE": "A", "AMPERES": "A",
    "MILLIMETRE": "MM", "MILLIMETRES": "MM", "MILLIMETER": "MM", "MILLIMETERS": "MM", "MM": "MM", "CM": "CM", "INCH": "IN", "INCHES": "IN", "IN": "IN",
    "BAR": "BAR", "PSI": "PSI", "RPM": "RPM", "KW": "KW", "KVA": "KVA", "HP": "HP", "W": "W", "V": "V", "A": "A",
}
GLUED_UNIT = r"(\d)(VOLTS?|KILOWATTS?|WATTS?|HERTZ|AMPERES?|AMPS?|MILLIMETRES?|MILLIMETERS?|INCHES?|HZ|KW|KVA|HP|MM|CM|BAR|PSI|RPM|W|V|A|IN)\b"

# Keywords by category, and subcategory labels by the first match.
KEYWORDS = {
    "Bearings": ["BEARING", "BRG", "BALL"],
    "Valves": ["VALVE", "VLV", "GATE", "GLOBE", "BUTTERFLY", "CHECK"],
    "Motors": ["MOTOR", "MTR", "INDUCTION"],
    "Pumps": ["PUMP", "PMP", "CENTRIFUGAL", "MONOBLOCK", "SUBMERSIBLE"],
    "Fasteners": ["BOLT", "NUT", "SCREW", "WASHER", "STUD"],
}
SUBCATEGORIES = {
    "Bearings": [("BALL", "Ball bearings"), ("ROLLER", "Roller bearings"), ("BEARING", "Bearings")],
    "Valves": [("GATE", "Gate valves"), ("GLOBE", "Globe valves"), ("BUTTERFLY", "Butterfly valves"), ("VALVE", "Valves")],
    "Motors": [("INDUCTION", "Induction motors"), ("MOTOR", "Motors")],
    "Pumps": [("CENTRIFUGAL", "Centrifugal pumps"), ("SUBMERSIBLE", "Submersible pumps"), ("MONOBLOCK", "Monoblock pumps"), ("PUMP", "Pumps")],
    "Fasteners": [("BOLT", "Bolts"), ("NUT", "Nuts"), ("SCREW", "Screws"), ("WASHER", "Washers"), ("STUD", "Studs")],
}

# Attribute extraction.
MANUFACTURERS = ["SKF", "FAG", "NSK", "NTN", "TIMKEN", "NACHI", "SKF-INDIA", "SIEMENS", "ABB", "WEG", "CG", "CROMPTON", "KSB", "GRUNDFOS", "KIRLOSKAR", "CRI", "AUDCO", "LNT", "LT", "AVEVA"]
SEALS = ["2RS", "2RS1", "2RSH", "RS", "RZ", "2RZ", "ZZ", "2Z", "Z", "LLU", "LLB", "DD"]
VALVE_TYPES = ["GATE", "GLOBE", "BUTTERFLY", "CHECK", "PLUG", "BALL"]
CONNECTIONS = ["RTJ", "RF", "FF", "SW", "BUTT_WELD", "THREADED", "FLANGED", "SCREWED"]
FASTENERS = ["BOLT", "NUT", "SCREW", "WASHER", "STUD"]
EXPECTED = {
    "Bearings": ["series", "seal_type"],
    "Motors": ["power_rating", "voltage_rating"],
    "Pumps": ["suction_size", "discharge_size"],
    "Valves": ["nominal_size", "pressure_class"],
    "Fasteners": ["thread_specification", "diameter"],
}
COMPONENTS = ["NUT", "WASHER", "SEAL", "GASKET", "COUPLING", "ADAPTER", "BOLT", "SCREW", "FLANGE", "CAP", "SPRING", "KEY", "PLATE", "O-RING", "ORING"]

# Matching.
STOPWORDS = ["AND", "WITH", "FOR", "THE", "OF", "TYPE", "MAKE", "MOUNT"]
EQUIVALENTS = {
    "BRG": "BEARING", "BRGS": "BEARING", "BEAR": "BEARING", "VLV": "VALVE", "MTR": "MOTOR", "MOT": "MOTOR", "PMP": "PUMP", "IND": "INDUCTION",
    "3PH": "THREE_PHASE", "1PH": "SINGLE_PHASE", "SS": "STAINLESS_STEEL", "MS": "MILD_STEEL", "CI": "CAST_IRON",
}
CRITICAL = {
    "Bearings": ["series", "seal_type", "bearing_type", "bore_diameter"],
    "Motors": ["motor_type", "power_rating", "voltage_rating", "frequency", "phase", "speed"],
    "Pumps": ["pump_type", "suction_size", "discharge_size", "power_rating", "casing_material"],
    "Valves": ["valve_type", "nominal_size", "pressure_class", "body_material", "end_connection"],
    "Fasteners": ["fastener_type", "thread_specification", "diameter", "length", "material_grade"],
}
NOMINAL = {
    "Bearings": ["series"],
    "Valves": ["nominal_size", "pressure_class"],
    "Pumps": ["suction_size", "discharge_size"],
    "Fasteners": ["thread_specification"],
}
WEIGHTS = {"semantic": 0.3, "fuzzy": 0.2, "technical": 0.3, "category": 0.2}

# Units of measure: those known, and seed rules (from, to, factor, type).
KNOWN_UOMS = ["EA", "PCS", "NOS", "SET", "KG", "G", "TON", "L", "ML", "M", "CM", "MM"]
CANONICAL_UOMS = ["EA", "G", "ML", "MM"]
UOM_RULES = [("PCS", "EA", 1, "ALIAS"), ("NOS", "EA", 1, "ALIAS"), ("KG", "G", 1000, "SCALE"), ("TON", "G", 1000000, "SCALE"), ("L", "ML", 1000, "SCALE"), ("M", "MM", 1000, "SCALE"), ("CM", "MM", 10, "SCALE")]
