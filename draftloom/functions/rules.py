"""Rule tables: fixed values that results depend on, in the order in which they are tried."""

from __future__ import annotations

# Categories of layers by parts of their names.
LAYER_HINTS = {
    "Wall": ["wall", "walls", "a-wall", "vegg", "vegger", "mur", "partition"],
    "Door": ["door", "doors", "a-door", "dor", "dorer", "deur"],
    "Window": ["window", "windows", "a-window", "vindu", "vinduer", "glass"],
    "Room": ["room", "rooms", "space", "spaces", "rom", "area"],
    "Dimension": ["dim", "dims", "dimension", "dimensions", "maal", "measure"],
    "Text": ["text", "txt", "anno", "annot", "annotation", "note", "notes"],
    "Grid": ["grid", "axis", "axes", "akse", "akser", "module"],
    "Structural": ["struct", "structural", "beam", "column", "col", "baering", "steel", "concrete"],
    "Equipment": ["equip", "equipment", "utstyr", "machine", "maskin", "process"],
    "Electrical": ["elec", "electrical", "power", "kraft", "lighting", "lys", "el-"],
    "HVAC": ["hvac", "vent", "ventilation", "duct", "kanal", "air", "luft"],
    "Plumbing": ["plumb", "plumbing", "vvs", "pipe", "pipes", "ror", "water", "drain"],
    "FireSafety": ["fire", "brann", "sprinkler", "alarm", "escape", "evac"],
    "Furniture": ["furn", "furniture", "chair", "chairs", "table", "tables", "sofa", "desk", "bed", "cabinet"],
    "Fixture": ["fixture", "fixtures", "casework", "kitchen", "counter", "appliance", "toilet", "wc", "sink", "shower", "bath"],
    "SurfacePattern": ["hatch", "hatches", "hatching", "pattern", "patterns", "tile", "tiles", "fill", "poche", "surface-pattern"],
}

# Phrases in a wall's evidence that take back trust, then those that give it.
NOT_TRUSTED = ("not trusted", "without shell support", "alone is not")
TRUSTED = (
    "source-backed exterior shell", "exterior shell continuity", "trusted exterior shell", "trusted long exterior shell", "trusted long isolated exterior shell", "trusted long main exterior shell", "global exterior-shell repair matched a trusted shell",
    "recovered wall body aligned to main floorplan perimeter shell", "wall-like layer exterior shell support", "wall or structural source layer", "filled wall-solid primitive", "filled closed vector wall body", "trusted benchmark",
)

# Uses of rooms by terms in their labels; the first that fits holds.
ROOM_USE = {
    "Corridor": ["corridor", "corr", "hallway", "passage", "passasje", "korridor", "gang"],
    "Outdoor": ["outdoor", "outside", "terrace", "terrasse", "balcony", "balkong", "veranda", "patio", "porch", "covered", "covered entry", "covered entrance", "overbygd", "overbygget", "overbygd inngang", "overbygget inngang", "canopy", "carport", "uteplass"],
    "Lobby": ["lobby", "reception", "vestibule", "entrance", "foyer", "inngang"],
    "Restroom": ["wc", "toilet", "restroom", "washroom", "lavatory", "urinal"],
    "Bathroom": ["bath", "bathroom", "bad", "shower", "dusj"],
    "Office": ["office", "kontor", "workspace", "workplace"],
    "Meeting": ["meeting", "conference", "moterom", "møterom", "boardroom"],
    "Storage": ["storage", "store", "lager", "closet", "archive", "arkiv", "gard", "garderobe", "wardrobe"],
    "Mechanical": ["mechanical", "mech", "pump", "boiler", "plant", "machine", "maskin", "teknisk"],
    "Electrical": ["electrical", "elec", "el", "switchgear", "transformer", "server", "data"],
    "Plumbing": ["plumbing", "vvs", "water", "sprinkler"],
    "HVAC": ["hvac", "ventilation", "vent", "ahu", "fan room"],
    "Utility": ["utility", "service", "renhold", "janitor", "cleaner"],
    "Kitchen": ["kitchen", "kitchenette", "kjokken", "kjøkken", "pantry"],
    "Living": ["living", "stue", "lounge", "family room"],
    "Bedroom": ["bedroom", "soverom", "sov", "sleeping"],
    "Stair": ["stair", "stairs", "staircase", "trapp", "trapperom"],
    "Elevator": ["elevator", "lift", "heis"],
    "Shaft": ["shaft", "sjakt", "riser"],
    "Laboratory": ["lab", "laboratory", "laboratorium"],
    "Industrial": ["production", "process", "workshop", "verksted", "industrial"],
    "Parking": ["parking", "garage", "garasje"],
    "CommonArea": ["common", "amenity", "break", "cafeteria", "kantine"],
}

# Categories of objects by words.
OBJECT_HINTS = {
    "Stair": ["stair", "stairs", "staircase", "trapp", "step"],
    "Elevator": ["elevator", "lift", "heis", "elev"],
    "Column": ["column", "col", "pillar", "post"],
    "Shaft": ["shaft", "riser", "void"],
    "PlumbingFixture": ["toilet", "wc", "sink", "lav", "basin", "shower", "bath", "urinal", "vvs", "plumb"],
    "ElectricalDevice": ["elec", "electrical", "outlet", "socket", "switch", "panel", "panelboard", "power", "db", "mccb"],
    "Lighting": ["light", "lighting", "lamp", "fixture", "luminaire", "downlight"],
    "HVACEquipment": ["hvac", "ahu", "vav", "vent", "diffuser", "duct", "fan", "grille", "damper", "air", "supply", "return", "exhaust"],
    "FireSafety": ["fire", "sprinkler", "alarm", "extinguisher", "hose", "hydrant", "escape", "smoke", "detector"],
    "Equipment": ["equip", "equipment", "machine", "pump", "valve", "tank", "compressor", "motor", "process", "vessel"],
    "Vehicle": ["vehicle", "car", "auto", "automobile", "parking", "parkering", "garage", "garasje", "bil"],
    "Furniture": ["desk", "chair", "table", "sofa", "bed", "cabinet", "furn", "furniture"],
    "Structural": ["beam", "brace", "steel", "concrete", "struct"],
    "Fixture": ["fixture", "casework", "kitchen", "counter", "appliance"],
}

# Categories by the letters that industrial tags start with.
TAG_PREFIXES = {
    "Equipment": ["P", "PU", "V", "HV", "XV", "CV", "SV", "PSV", "TK", "T", "VES", "HX", "HE", "PMP", "CMP"],
    "HVACEquipment": ["AHU", "VAV", "FCU", "RTU", "EF", "SF", "RF", "FAN"],
    "ElectricalDevice": ["DB", "MCC", "MSB", "LP", "PP"],
    "FireSafety": ["FA", "FACP", "SP"],
}


def values(rules: dict[str, list[str]], names: str = "ord, kind, term") -> str:
    """A rule table as SQL: its order, what it says and the term it looks for."""
    rows = [f"({i}, '{kind}', '{term}')" for i, (kind, term) in enumerate((k, t) for k, terms in rules.items() for t in terms)]
    return f"(VALUES {', '.join(rows)}) AS rules({names})"
