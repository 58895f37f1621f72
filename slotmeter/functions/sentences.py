"""Declarative sentences from slot values, as hypotheses of an entailment model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotmeter.functions.values import strip

#: Words that mean no, and values that say nothing.
NEGATIVE = ("no", "false", "0", "no_internet", "no_credit_cards", "no_pets_allowed", "no_usb_port", "not_on_steam", "not_business_oriented", "not-family-friendly", "not_child_friendly")
DONTCARE = ("dontcare", "dont_care", "none")
#: Prefixes that a readable slot name leaves out, one of each line.
DIALOG_PREFIXES = ("auto_repair.", "coffee_ordering.", "movie_ticket.", "pizza_ordering.", "restaurant_reservation.", "uber_lyft.")
ACT_PREFIXES = ("hotel_", "laptop_", "restaurant_", "tv_")

#: What is said of a slot.
TEXTS = {
    "name": "The name is {value}.",
    "venue_type": "It is a {value}.",
    "cuisine_type": "The food type is {value}.",
    "priceRange": "The price range is {value}.",
    "customerRating": "The customer rating is {value}.",
    "area_zone": "It is in the {value} area.",
    "nearby_landmark": "It is near {value}.",
    "eatType": "It is a {value}.",
    "food": "The food type is {value}.",
    "area": "It is in the {value} area.",
    "near": "It is near {value}.",
    "developer": "The developer is {value}.",
    "esrb_rating": "The ESRB rating is {value}.",
    "exp_release_date": "The expected release date is {value}.",
    "genres": "The genre is {value}.",
    "perspective": "The perspective is {value}.",
    "platforms": "It is available on {value}.",
    "released": "It was released in {value}.",
    "review_rating": "The review rating is {value}.",
    "specifier": "The game is {value}.",
    "hotel_name": "The hotel name is {value}.",
    "hotel_type": "The venue type is {value}.",
    "hotel_price_range": "The price range is {value}.",
    "hotel_address": "The address is {value}.",
    "hotel_postcode": "The postcode is {value}.",
    "hotel_area": "It is in the {value} area.",
    "hotel_near": "It is near {value}.",
    "hotel_phone": "The phone number is {value}.",
    "hotel_count": "There are {value} results.",
    "laptop_name": "The laptop name is {value}.",
    "laptop_type": "The device type is {value}.",
    "laptop_family": "The laptop family is {value}.",
    "laptop_price": "The price is {value}.",
    "laptop_price_range": "The price range is {value}.",
    "laptop_battery": "The battery life is {value}.",
    "laptop_battery_rating": "The battery rating is {value}.",
    "laptop_design": "The design is {value}.",
    "laptop_dimension": "The dimension is {value}.",
    "laptop_drive": "The drive size is {value}.",
    "laptop_drive_range": "The drive range is {value}.",
    "laptop_memory": "The memory is {value}.",
    "laptop_platform": "The platform is {value}.",
    "laptop_processor": "The processor is {value}.",
    "laptop_utility": "The utility is {value}.",
    "laptop_warranty": "The warranty is {value}.",
    "laptop_weight": "The weight is {value}.",
    "laptop_weight_range": "The weight range is {value}.",
    "laptop_count": "There are {value} results.",
    "restaurant_name": "The restaurant name is {value}.",
    "restaurant_type": "The venue type is {value}.",
    "restaurant_food": "The food type is {value}.",
    "restaurant_price_range": "The price range is {value}.",
    "restaurant_price": "The price is {value}.",
    "restaurant_address": "The address is {value}.",
    "restaurant_postcode": "The postcode is {value}.",
    "restaurant_area": "It is in the {value} area.",
    "restaurant_near": "It is near {value}.",
    "restaurant_phone": "The phone number is {value}.",
    "restaurant_count": "There are {value} results.",
    "restaurant_good_for_meal": "It is good for {value}.",
    "tv_name": "The TV name is {value}.",
    "tv_type": "The TV type is {value}.",
    "tv_family": "The TV family is {value}.",
    "tv_price": "The price is {value}.",
    "tv_price_range": "The price range is {value}.",
    "tv_resolution": "The resolution is {value}.",
    "tv_screen_size": "The screen size is {value}.",
    "tv_screen_size_range": "The screen size range is {value}.",
    "tv_eco_rating": "The eco rating is {value}.",
    "tv_hdmi_port": "It has {value} HDMI ports.",
    "tv_power_consumption": "The power consumption is {value}.",
    "tv_accessories": "The accessories include {value}.",
    "tv_audio": "The audio is {value}.",
    "tv_color": "The color is {value}.",
    "tv_count": "There are {value} results.",
    "auto_repair.name.store": "The auto shop name is {value}.",
    "auto_repair.name.customer": "The customer name is {value}.",
    "auto_repair.name.vehicle": "The vehicle is {value}.",
    "auto_repair.date.appt": "The appointment date is {value}.",
    "auto_repair.time.appt": "The appointment time is {value}.",
    "auto_repair.reason.appt": "The reason for the appointment is {value}.",
    "auto_repair.year.vehicle": "The vehicle year is {value}.",
    "auto_repair.location.store": "The shop location is {value}.",
    "auto_repair.appointment": "The appointment status is {value}.",
    "coffee_ordering.name.drink": "The drink is {value}.",
    "coffee_ordering.size.drink": "The drink size is {value}.",
    "coffee_ordering.num.drink": "The number of drinks is {value}.",
    "coffee_ordering.type.milk": "The milk type is {value}.",
    "coffee_ordering.preference": "The preference is {value}.",
    "coffee_ordering.location.store": "The store location is {value}.",
    "coffee_ordering.coffee_order": "The order status is {value}.",
    "movie_ticket.name.movie": "The movie is {value}.",
    "movie_ticket.name.theater": "The theater is {value}.",
    "movie_ticket.num.tickets": "The number of tickets is {value}.",
    "movie_ticket.time.start": "The showtime is {value}.",
    "movie_ticket.time.end": "The show ends at {value}.",
    "movie_ticket.price.ticket": "The ticket price is {value}.",
    "movie_ticket.type.screening": "The screening type is {value}.",
    "movie_ticket.location.theater": "The theater location is {value}.",
    "movie_ticket.ticket_booking": "The ticket booking status is {value}.",
    "pizza_ordering.name.store": "The pizza store is {value}.",
    "pizza_ordering.name.pizza": "The pizza is {value}.",
    "pizza_ordering.size.pizza": "The pizza size is {value}.",
    "pizza_ordering.type.crust": "The crust type is {value}.",
    "pizza_ordering.type.topping": "The topping is {value}.",
    "pizza_ordering.preference": "The preference is {value}.",
    "pizza_ordering.location.store": "The store location is {value}.",
    "pizza_ordering.pizza_order": "The order status is {value}.",
    "pizza_ordering.pizza_ordering": "The pizza order is {value}.",
    "restaurant_reservation.name.restaurant": "The restaurant name is {value}.",
    "restaurant_reservation.name.reservation": "The reservation name is {value}.",
    "restaurant_reservation.num.guests": "The number of guests is {value}.",
    "restaurant_reservation.time.reservation": "The reservation time is {value}.",
    "restaurant_reservation.type.seating": "The seating type is {value}.",
    "restaurant_reservation.location.restaurant": "The restaurant location is {value}.",
    "restaurant_reservation.reservation": "The reservation status is {value}.",
    "restaurant_reservation.restaurant_reservation": "The reservation is for {value}.",
    "uber_lyft.location.from": "The pickup location is {value}.",
    "uber_lyft.location.to": "The dropoff location is {value}.",
    "uber_lyft.type.ride": "The ride type is {value}.",
    "uber_lyft.num.people": "The number of passengers is {value}.",
    "uber_lyft.price.estimate": "The estimated price is {value}.",
    "uber_lyft.duration.estimate": "The estimated duration is {value}.",
    "uber_lyft.time.pickup": "The pickup time is {value}.",
    "uber_lyft.time.dropoff": "The dropoff time is {value}.",
    "uber_lyft.ride_booking": "The ride booking status is {value}.",
    "uber_lyft.uber_lyft": "The ride service is {value}.",
}
#: Sentences of yes and no; a value that means neither counts as yes.
YES_NO = {
    "familyFriendly": ("It is family-friendly.", "It is not family-friendly."),
    "hotel_has_internet": ("It has internet.", "It does not have internet."),
    "hotel_accepts_credit_cards": ("It accepts credit cards.", "It does not accept credit cards."),
    "hotel_pets_allowed": ("Pets are allowed.", "Pets are not allowed."),
    "laptop_is_for_business_computing": ("It is for business computing.", "It is not for business computing."),
    "tv_has_usb_port": ("It has a USB port.", "It does not have a USB port."),
}
#: Sentences of single values, compared as written, and that of all others.
CASES = {
    "family_suitability": ({"family-friendly": "It is family-friendly."}, "It is not family-friendly."),
    "multiplayer_mode": ({"multiplayer": "It has multiplayer."}, "It is single-player."),
    "steam_availability": ({"on_steam": "It is available on Steam."}, "It is not available on Steam."),
    "pc_os_support": (
        {
            "Linux": "It is available on Linux.",
            "macOS": "It is available on macOS.",
            "not_released_on_Linux": "It is not available on Linux.",
            "not_released_on_macOS": "It is not available on macOS.",
        },
        "The PC OS support is {value}.",
    ),
}
#: A slot whose sentences are for these values in any case, and for no others.
KIDS = ("restaurant_kidsallowed", ("yes", "true"), "Kids are allowed.", ("no", "false"), "Kids are not allowed.")

REGISTERED = (*TEXTS, *YES_NO, *CASES, KIDS[0])


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a small fixed table, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def readable(slot: Column) -> Column:
    """The slot's name in words, without the prefix of its domain."""
    bare = slot
    for prefixes in (DIALOG_PREFIXES, ACT_PREFIXES):
        bare = F.regexp_replace(bare, "^(" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")", "")
    return F.translate(bare, "._", "  ")


def sentence(slot: Column, value: Column, yes_no: dict[str, tuple[str, str]] | None = None) -> Column:
    """A declarative sentence; null for values that say nothing, and for kids allowed neither way.

    ``yes_no`` adds slots of one's own with their two sentences. A slot without an entry reads "The <name> is <value>.".
    """
    both = {**YES_NO, **(yes_no or {})}
    low = F.lower(strip(value))
    filled = lambda text: F.replace(text, F.lit("{value}"), value)
    kids, yes, allowed, no, barred = KIDS
    out = F.when(low.isin(*DONTCARE), F.lit(None).cast("string")).when(slot == kids, F.when(F.lower(value).isin(*yes), allowed).when(F.lower(value).isin(*no), barred))
    for name, (known, other) in CASES.items():
        out = out.when(slot == name, F.coalesce(lookup(known, value), filled(F.lit(other))))
    out = out.when(slot.isin(*both), F.when(low.isin(*NEGATIVE), lookup({k: v[1] for k, v in both.items()}, slot)).otherwise(lookup({k: v[0] for k, v in both.items()}, slot)))
    return out.otherwise(filled(F.coalesce(lookup(TEXTS, slot), F.concat(F.lit("The "), readable(slot), F.lit(" is {value}.")))))
