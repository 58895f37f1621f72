"""Words and rules by which slot values are recognised in texts, for three families of corpora.

All values here are fixed values: another word or order gives other results.
"""

from __future__ import annotations

#: Words for ratings and prices, shared by the families.
RATING = {
    "excellent": ["5 out of", "5 star", "adore", "amazing", "attract", "awesome", "best", "fantastic", "favorite", "five", "great", "high", "highly", "love", "loved", "loving", "quality", "special", "superb", "top", "unique"],
    "good": ["acclaim", "cool", "enjoy", "fun", "like", "liked", "positive", "solid", "well"],
    "average": ["3 out of", "3 star", "all right", "alright", "decent", "kinda", "kind of", "lukewarm", "mediocre", "meh", "middle", "middling", "mixed", "moderate", "ok", "okay", "ordinary", "so so", "three", "unimpress"],
    "poor": ["1 out of", "1 star", "avoid", "bad", "badly", "boring", "detest", "disappoint", "dislike", "dull", "hate", "hated", "hating", "lackluster", "lacking", "loathe", "low", "lowly", "negative", "one", "poorly", "underwhelm", "wrong"],
}
PRICE = {
    "cheap": ["less than £20", "less than 20", "under £20", "under 20", "inexpensive", "affordable", "low", "lower", "budget", "bargain"],
    "moderate": ["20 25", "20 to 25", "between 20 and 25", "average", "reasonable"],
    "high": ["more than £30", "more than 30", "over £30", "over 30", "expensive", "costly", "pricey", "high", "higher"],
    "less than £20": ["less than 20", "under £20", "under 20", "cheap", "inexpensive", "affordable", "low", "budget"],
    "£20 25": ["20 25", "20 to 25", "between 20 and 25", "moderate", "average", "reasonable"],
    "more than £30": ["more than 30", "over £30", "over 30", "high", "expensive", "costly", "pricey", "high"],
}
AREA = {"city centre": ["center", "centre", "downtown", ["middle", "city"], ["middle", "town"]], "riverside": ["river"]}
#: Customer ratings and the rating they stand for.
CUSTOMER = {"low": "poor", "average": "average", "high": "excellent", "1 out of 5": "poor", "3 out of 5": "average", "5 out of 5": "excellent"}
GENRES = {
    "action adventure": [["action", "adventur"]],
    "adventure": ["adventur"],
    "driving racing": ["driving", "drive", "racing", "race"],
    "fighting": ["fight"],
    "mmorpg": ["massive"],
    "platformer": ["platforming"],
    "real time strategy": ["real time", "rts"],
    "role playing": ["roleplaying", "role play", "rpg", "rpgs"],
    "shooter": ["shoot", "fps"],
    "simulation": ["simulat", "sim"],
    "strategy": ["strateg"],
    "tactical": ["tactic"],
    "trivia board game": ["trivia", "board"],
    "turn based strategy": ["turn based"],
    "vehicular combat": [["vehic", "combat"]],
}
ESRB = {
    "e (for everyone)": ["e rated", "rated e", "e rating", "rating e", "everyone", "all"],
    "e 10+ (for everyone 10 and older)": ["e10+", "e 10+", "e 10 plus", "everyone 10", "everyone above", "everyone over", "everyone older"],
    "t (for teen)": ["t rated", "rated t", "t rating", "rating t", "teen", "teens", "teenagers"],
    "m (for mature)": ["m rated", "rated m", "m rating", "rating m", "mature", "adult"],
}
PRICE_STEMS = ["price", "pricing", "cost", "costs", "dollars", "pounds", "euros", "$", "£", "€"]
RATING_STEMS = ["rating", "ratings", "rated", "rate", "review", "reviews"]
#: What says that any value will do.
INDIFFERENT = ("any", "all", "vary", "various", "different", "regardless", "matter", "no preference", "dont care", "dont mind", "not care", "not mind")
INDIFFERENT_ACTS = (*INDIFFERENT, "do not care")

#: Words that mention a slot.
MENTIONS = {
    "restaurants": {
        "area": ["area", "location", "neighborhood", "place", "where"],
        "food": ["food", "cuisine"],
        "eattype": ["eat"],
        "familyfriendly": ["family", "kid", "kids", "child", "children"],
        "pricerange": ["price"],
        "customerrating": ["customer", "rating"],
        "name": ["name"],
        "near": ["near"],
    },
    "acts": {
        "address": ["address"],
        "area": ["area", "part of the city", "part of the town", "part"],
        "count": [],
        "food": ["food"],
        "goodformeal": ["meal"],
        "name": ["name"],
        "near": ["area", "part of the city", "part of the town", "part"],
        "phone": ["phone number", "number", "telephone number", "phone"],
        "postcode": ["postcode", "post code", "zipcode", "zip code"],
        "price": ["price"],
        "pricerange": ["price range", "pricerange", "range", "price"],
        "type": [],
        "battery": ["battery", "battery life"],
        "batteryrating": ["battery rating", "battery life", "battery"],
        "design": ["design"],
        "dimension": ["size", "dimension", "display"],
        "drive": ["drive", "hard drive", "drive size"],
        "driverange": ["drive range", "hard drive range", "drive size", "hard drive"],
        "family": ["family", "product line", "product family", "line"],
        "memory": ["memory"],
        "platform": ["platform", "operating system", "os"],
        "processor": ["processor", "cpu"],
        "utility": ["utility"],
        "warranty": ["warranty"],
        "weight": ["weight"],
        "weightrange": ["weight range", "weight"],
        "kidsallowed": ["child", "children", "kid", "kids"],
        "dogsallowed": ["dog", "dogs", "puppy"],
        "hasinternet": ["internet", "wifi", "internet connection", "internet service"],
        "acceptscreditcards": ["credit cards", "credit card", "cards", "card"],
        "isforbusinesscomputing": ["business", "home use", "business use", "business computing", "personal use"],
        "hasusbport": ["usb port", "usb"],
        "hdmiport": ["hdmi port", "hdmi"],
        "ecorating": ["eco rating", "eco"],
        "audio": ["audio"],
        "accessories": ["accessories", "accessory"],
        "color": ["color", "colour"],
        "powerconsumption": ["power consumption", "consumption", "power"],
        "resolution": ["resolution"],
        "screensize": ["screen size"],
        "screensizerange": ["screen size range"],
    },
    "games": {
        "available_on_steam": ["steam"],
        "genres": ["genre"],
        "has_linux_release": ["linux"],
        "has_mac_release": ["mac"],
        "has_multiplayer": ["multiplayer", "friends", "others"],
        "name": ["name", "particular", "specific", "what", "which"],
        "platforms": ["platform"],
        "player_perspective": ["perspective"],
        "release_year": ["year"],
    },
}

#: Slots whose values are names, masked before others are looked for.
NAMES = {"restaurants": ("name", "near"), "acts": ("name", "near", "address"), "games": ("addr", "depart", "dest", "developer", "name", "near")}
#: The family of each topic's rules.
FAMILY = {"restaurants": "restaurants", "restaurant": "acts", "hotel": "acts", "laptop": "acts", "tv": "acts", "games": "games"}


def _boolean(stems: list, antonyms: list = (), yes: str = "yes", no: str = "no") -> dict:
    return {"kind": "boolean", "stems": stems, "antonyms": list(antonyms), "yes": yes, "no": no}


def _scalar(stems: list, values: dict | None = None) -> dict:
    return {"kind": "scalar", "stems": stems, "values": values or {}}


_KIDS = ["family", "families", "kid", "kids", "child", "children"]
_ACT_BOOLEANS = {
    "kidsallowed": _boolean(["child", "children", "kid", "kids", "family", "families"], ["adult", "adults"]),
    "dogsallowed": _boolean(["dog", "dogs", "pet", "pets", "puppy", "animal", "animals"]),
    "hasinternet": _boolean(["internet", "wifi", "wi fi"]),
    "acceptscreditcards": _boolean(["card", "cards", "credit"]),
    "isforbusinesscomputing": _boolean(["business"], ["personal", "general", "home", "nonbusiness"], "true", "false"),
    "hasusbport": _boolean(["usb"], [], "true", "false"),
}
_TYPE = {"kind": "first_word", "values": {"television": ["tv"]}}
_PLACES = {"area": {"kind": "categorical", "values": AREA}, "pricerange": _scalar(PRICE_STEMS, PRICE), "food": {"kind": "substring"}, "count": {"kind": "numeric"}, "type": _TYPE}
_UNITS = {s: {"kind": "unit"} for s in ("battery", "dimension", "drive", "weight", "powerconsumption", "price", "screensize")}
_LISTS = {s: {"kind": "conjunction"} for s in ("design", "utility", "accessories", "color")}
_GOODS = {"pricerange": _scalar(PRICE_STEMS, PRICE), "count": {"kind": "numeric"}, "type": _TYPE}

#: How each topic's slots are looked for; others verbatim.
RULES = {
    "restaurants": {
        "familyfriendly": _boolean(_KIDS, ["adult", "adults"]),
        "food": {"kind": "food"},
        "area": {"kind": "categorical", "values": AREA},
        "eattype": {"kind": "categorical"},
        "pricerange": _scalar(PRICE_STEMS, PRICE),
        "customerrating": _scalar(["customer", *RATING_STEMS, "star", "stars"], {v: [r, *RATING[r]] for v, r in CUSTOMER.items()}),
    },
    "restaurant": _ACT_BOOLEANS | _PLACES,
    "hotel": _ACT_BOOLEANS | _PLACES,
    "laptop": _ACT_BOOLEANS | _UNITS | _LISTS | _GOODS | {"batteryrating": _scalar(["battery"]), "weightrange": _scalar(["weight"]), "driverange": _scalar(["drive"])},
    "tv": _ACT_BOOLEANS | _UNITS | _LISTS | _GOODS | {"ecorating": _scalar(["eco"]), "screensizerange": _scalar(["screen"]), "hdmiport": {"kind": "numeric"}},
    "games": {
        "platforms": {"kind": "items_first_word"},
        "player_perspective": {"kind": "items_first_word", "values": {"first person": ["fps"], "bird view": ["top down"]}},
        "genres": {"kind": "items", "values": GENRES},
        "release_year": {"kind": "year"},
        "esrb": _scalar(["esrb"], ESRB),
        "rating": _scalar(RATING_STEMS, RATING),
        "available_on_steam": _boolean(["steam"]),
        "has_linux_release": _boolean(["linux"]),
        "has_mac_release": _boolean(["mac"]),
        "has_multiplayer": _boolean(["multiplayer", "friends", "others"], ["single player"]),
    },
}
