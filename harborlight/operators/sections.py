"""Detail sections of each source's rows, as arrays of (id, title, items) without empty ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import from_epoch_ms, survey_date
from ..functions.numbers import feet, s57_code
from ..functions.text import aid_phrase, informative_correction, light_character, lookup, present, safe_link, spaced_enum, spaced_field, status_phrase
from ..sources import enc, notices, openseamap, ports, stations
from ..sources.lightlist import RANGE_UNITS, number_text
from .detail import ITEM

# Survey-quality and technique codes of charts.
SOUNDING_QUALITY = {
    1: "depth known", 2: "depth unknown", 3: "doubtful sounding", 4: "unreliable sounding", 5: "no bottom found at value shown",
    6: "least depth known", 7: "least depth unknown but safe to depth shown",
}
SURVEY_TECHNIQUE = {
    1: "found by echo sounder", 2: "found by side-scan sonar", 3: "found by multi-beam", 4: "found by diver", 5: "found by lead-line",
    6: "swept by wire-drag", 7: "found by laser", 8: "swept by vertical acoustic system", 9: "found by electromagnetic sensor",
    10: "computed", 11: "estimated", 12: "found by manual sounding", 13: "found by satellite imagery", 14: "found by levelling",
}
# Fields with an availability and their labels, by section of the community's details.
OFFERS = {
    "fuel": {"diesel": "Diesel", "ethanolFree": "Ethanol free", "gas": "Unleaded", "propane": "Propane", "electric": "Electric charging"},
    "amenity": {
        "bar": "Bar", "cellReception": "Cell reception", "boatRamp": "Boat ramp", "laundry": "Laundry", "courtesyCar": "Courtesy car",
        "pets": "Pets allowed", "lodging": "Lodging", "restroom": "Restrooms", "restaurant": "Restaurant", "transportation": "Transportation",
        "shower": "Showers", "water": "Water", "trash": "Rubbish disposal", "wifi": "Wi-Fi",
    },
    "services": {
        "haulOut": "Haul-out", "pumpOut": "Pump-out", "repair": "General repair", "mechanical": "Mechanical repair",
        "repairDieselEngines": "Diesel engine repair", "repairGasEngines": "Gas engine repair", "electronics": "Electronics",
        "sailsAndRigging": "Sails and rigging", "fiberglass": "Fiberglass", "welding": "Welding", "propellerRepair": "Propeller repair",
        "canvasAndUpholstery": "Canvas and upholstery", "paint": "Painting", "bottomPainting": "Bottom painting",
        "washAndWax": "Wash and wax", "marineHvac": "Marine HVAC", "plumbing": "Plumbing", "carpentry": "Carpentry", "storage": "Storage",
        "charter": "Charter", "boatBrokers": "Boat brokers", "surveyors": "Surveyors", "towing": "Towing",
        "rescueAndSalvage": "Rescue and salvage", "waterTaxi": "Water taxi",
    },
    "retail": {
        "grocery": "Grocery", "ice": "Ice", "fishingSupplies": "Fishing supplies", "marineRetail": "Marine supplies", "hardware": "Hardware",
    },
    "business": {
        "seasonal": "Seasonal", "public": "Open to public", "cash": "Cash accepted", "check": "Cheques accepted", "credit": "Cards accepted",
    },
    "mooring": {"hasMoorings": "Moorings available", "dinghy": "Dinghy dock", "launch": "Launch service", "liveaboard": "Liveaboard"},
    "dockage": {"liveaboard": "Liveaboard", "secureAccess": "Secure access", "securityPatrol": "Security patrol"},
    "navigation": {"fixedBridge": "Fixed bridge"},
}
NUMBERS = {
    "dockage": ("total", "transient", "loaMax", "beamMax"), "mooring": ("total", "transient"), "fuel": ("depthFuel",),
    "navigation": ("bridgeHeight", "tide", "depthApproach"),
}
TEXTS = {
    "dockage": ("distanceUnit",), "fuel": ("distanceUnit",), "navigation": ("current", "distanceUnit"),
    "contact": ("vhfChannel", "phone", "afterHourContact", "email", "website"), "featuredReview": ("title", "text", "createdBy"),
}
DEFINITE = ("Yes", "No", "Nearby")


def community_schema() -> str:
    """The schema of the community's detail responses, as far as sections read it."""
    parts = ["pointOfInterest struct<id:string,name:string,poiType:string,mapLocation:struct<latitude:double,longitude:double>,"
             "dateLastModified:string,notes:array<struct<field:string,value:string>>>",
             "reviewSummary struct<averageRating:double,numberOfReviews:bigint>"]
    for name in (*OFFERS, "contact", "featuredReview"):
        fields = [f"{k}:string" for k in (*OFFERS.get(name, ()), *TEXTS.get(name, ()))] + [f"{k}:double" for k in NUMBERS.get(name, ())]
        fields += ["isFree:boolean"] if name in ("dockage", "mooring") else []
        parts.append(f"{name} struct<{','.join(fields)},notes:array<struct<field:string,value:string>>>")
    return ",".join(parts)


def made(label, value: Column, kind: str = "text", unit=None) -> Column:
    """An array of one item, or of none where there is no value. label and unit: texts or columns."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    text = F.nullif(value.cast("string"), F.lit(""))
    one = F.struct(as_column(label).alias("label"), text.alias("value"), F.lit(kind).alias("kind"), F.nullif(as_column(unit), F.lit("")).alias("unit"))
    return F.when(text.isNotNull(), F.array(one)).otherwise(F.array().cast(f"array<{ITEM}>"))


def text_item(label, value: Column) -> Column:
    return made(label, present(value))


def measure(label, value: Column, unit="m") -> Column:
    return made(label, value, "measure", unit)


def flag(label: str, value: Column) -> Column:
    return made(label, value, "flag")


def joined(parts: list[tuple[str, str, list[Column]]]) -> Column:
    """Sections of item arrays, laid end to end within each section."""
    whole = [F.struct(F.lit(n).alias("id"), F.lit(t).alias("title"), F.concat(*items).alias("items")) for n, t, items in parts]
    return F.filter(F.array(*whole), lambda s: F.size(s["items"]) > 0)


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def enc_sections(layer: str) -> Column:
    c = F.col
    category = present(c("CATWRK") if layer == "wreck" else c("CATOBS")) if layer != "rock" else F.lit(None).cast("string")
    danger = enc.dangerous(category)
    surveyed = F.when(F.trim("SORDAT").rlike("^[0-9]{6}$"), F.date_format(survey_date(c("SORDAT")), "yyyy-MM")).otherwise(day(survey_date(c("SORDAT"))))
    return joined([
        ("feature", "Feature", [flag("Dangerous", danger), text_item("Name", c("OBJNAM")), made("Category", F.when(danger.isNull(), category))]),
        ("depth", "Depth", [
            measure(enc.depth_label(c("QUASOU")), c("VALSOU")), made("Water level", enc.water_level(c("WATLEV"))),
            measure("Sounding accuracy", F.when(c("VALSOU").isNotNull(), c("SOUACC"))),
        ]),
        ("quality", "Quality", [
            made("Position quality", lookup(SOUNDING_QUALITY, s57_code(c("QUASOU")))), made("Survey technique", lookup(SURVEY_TECHNIQUE, s57_code(c("TECSOU")))),
        ]),
        ("information", "Information", [made("Information", present(c("INFORM")), "note")]),
        ("source", "Source", [text_item("Dataset", c("DSNM")), made("Surveyed", surveyed)]),
    ])


def light_list_sections() -> Column:
    """For rows of lightlist.records."""
    c = F.col
    unit = lambda name: F.coalesce(lookup(RANGE_UNITS, c(f"{name}.unit")), c(f"{name}.unit"))
    lower = lambda name: F.lower(f"{name}.unit")
    return joined([
        ("light", "Light", [
            made("Character", c("light")), measure("Nominal range", c("nominal_range.value"), unit("nominal_range")),
            measure("Focal plane", c("focal_plane.value"), lower("focal_plane")),
        ]),
        ("structure", "Structure", [made("Type", c("structure")), measure("Height", c("structure_height.value"), lower("structure_height"))]),
        ("daymark", "Daymark", [made("Color", c("daymark_color")), made("Shape", c("daymark_shape"))]),
        ("signals", "Signals", [made("Sound signal", c("sound")), made("RACON", c("racon"))]),
        ("remarks", "Remarks", [made("Remark", c("remark"), "note")]),
        ("source", "Source", [
            made("LLNR", c("llnr")), made("Volume", number_text(c("volume"))), made("Last updated", day(c("modified"))),
            flag("Inactive", F.when(c("inactive"), True)),
        ]),
    ])


def notice_sections(layer: str) -> Column:
    c = F.col
    spec = notices.LAYERS[layer]
    when = lambda name: day(from_epoch_ms(c(name)))
    if spec.kind == "notice":
        updated = F.coalesce(when("MODIFIED_DATE"), when("CREATE_DATE"))
        first = [
            ("notice", "Notice", [
                text_item("Category", c("SUB_CATEGORY")), text_item("Type", c("TYPE")), text_item("Waterway", c("WATERWAY_NAME")),
                made("Effective from", when("BEGIN_DATE")), made("Effective to", when("END_DATE")),
            ]),
            ("description", "Description", [made("Notice text", present(c("DESCRIPTION")), "note")]),
        ]
    else:
        updated = when("CREATE_DATE")
        status = F.coalesce(present(c("DISCREP_STATUS")), present(c("TC_STATUS")))
        correction = F.coalesce(present(c("DISCREP_CORR_STATUS")), present(c("TC_CORR_STATUS")))
        first = [
            ("condition", "Aid condition", [
                made("Status", status_phrase(status)), made("Correction", F.when(informative_correction(correction), correction)),
                made("Affected aid", aid_phrase(present(c("COLOR")), present(c("DESCRIPTION_TYPE")))), text_item("Waterway", c("WATERWAY_NAME")),
            ]),
            ("identity", "Affected aid identity", [made("LLNR", number_text(c("LLNR"))), text_item("Broadcast Notice to Mariners", c("BNM_NUM"))]),
        ]
    source = [made("Notice", F.lit(spec.label)), made("Coast Guard District", number_text(c("ATU"))), made("Updated", updated)]
    return joined([*first, ("source", "Source", source)])


def structure_sections(layer: str) -> Column:
    c = F.col
    long = lambda label, name: measure(label, feet(c(name)))
    year = lambda label, name: made(label, c(name).cast("long"))
    if layer == "lock":
        return joined([
            ("chamber", "Chamber", [
                text_item("Name", c("PMSNAME")), long("Length", "LENGTH"), long("Width", "WIDTH"), long("Lift", "LIFT"), text_item("Gate type", c("GATETYPE")),
            ]),
            ("location", "Location", [
                text_item("River", c("RIVER")), made("River mile", _one_decimal(c("RIVERMI"))),
                text_item("State", c("STATE")),
            ]),
            ("source", "Source", [year("Opened", "YEAROPEN")]),
        ])
    return joined([
        ("structure", "Structure", [
            text_item("Name", c("NAME")), text_item("Dam type", c("PRIMARY_DAM_TYPE")), long("Height", "DAM_HEIGHT"), long("Length", "DAM_LENGTH"),
            text_item("Purpose", c("PRIMARY_PURPOSE")),
        ]),
        ("location", "Location", [text_item("River", c("RIVER_OR_STREAM")), text_item("City", c("CITY")), text_item("State", c("STATE"))]),
        ("safety", "Safety", [text_item("Hazard potential", c("HAZARD_POTENTIAL")), text_item("Condition", c("CONDITION_ASSESSMENT"))]),
        ("source", "Source", [text_item("Owner", c("PRIMARY_OWNER_TYPE")), year("Completed", "YEAR_COMPLETED")]),
    ])


def _one_decimal(x: Column) -> Column:
    tenths = F.floor(F.abs(x) * 10 + 0.5).cast("long")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))


def station_sections(kind: str) -> Column:
    c = F.col
    number = present(c("id"))
    page = F.concat(F.lit(stations.KINDS[kind][1]), F.replace(F.url_encode(number), F.lit("+"), F.lit("%20")))
    return joined([
        ("station", "Station", [made("Station ID", number), made("Type", F.lit(stations.KINDS[kind][0])), text_item("State", c("state")), text_item("Time zone", c("timezone"))]),
        ("links", "Links", [made("Station page", safe_link(page), "link")]),
    ])


def port_sections() -> Column:
    c = F.col
    return joined([
        ("harbor", "Harbor", [made("Size", ports.label(ports.SIZES, c("harborSize"))), made("Shelter", ports.label(ports.SHELTER, c("shelter")))]),
        ("depths", "Depths", [measure("Channel depth", ports.metres(c("chDepth")))]),
        ("vessel", "Maximum vessel", [measure("Length", ports.metres(c("maxVesselLength")))]),
        ("services", "Services", [flag("First port of entry", ports.flag(c("firstPortOfEntry")))]),
    ])


def seamark_sections() -> Column:
    """For elements with tags."""
    get = lambda name: present(openseamap.tag(F.col("tags"), name))
    mark = F.lower(get("seamark:type"))
    family = lambda what: spaced_enum(present(F.try_element_at("tags", F.concat(F.lit("seamark:"), mark, F.lit(":" + what)))))

    def reading(label: str, name: str, unit: str) -> Column:
        raw = get(name)
        number = raw.try_cast("double")
        return F.when(number.isNotNull(), measure(label, number, unit)).otherwise(made(label, raw))

    return joined([
        ("feature", "Feature", [made("Category", family("category")), made("Colour", family("colour")), made("Shape", family("shape"))]),
        ("light", "Light", [
            made("Character", light_character(get("seamark:light:character"))), made("Colour", spaced_enum(get("seamark:light:colour"))),
            reading("Period", "seamark:light:period", "s"), reading("Range", "seamark:light:range", "NM"), reading("Height", "seamark:light:height", "m"),
            made("Exhibition", spaced_enum(get("seamark:light:exhibition"))),
        ]),
        ("notes", "Notes", [made("Information", get("seamark:information"), "note"), made("Notice", get("seamark:notice"), "note")]),
    ])


def community_sections() -> Column:
    """For rows of community_schema."""
    c = F.col

    def offers(section: str) -> list[Column]:
        # One array of labels and answers, filtered: an expression for each of some fifty offers made plans slow.
        asked = F.array(*(F.struct(F.lit(label).alias("label"), c(f"{section}.{k}").alias("value")) for k, label in OFFERS[section].items()))
        told = F.filter(asked, lambda x: x["value"].isin(*DEFINITE))
        return [F.transform(told, lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value"), F.lit("availability").alias("kind"), F.lit(None).cast("string").alias("unit")))]

    def notes(section: str) -> Column:
        label = lambda n: F.when(F.lower(n["field"]).isin("poinotes", "notes"), "Notes").otherwise(
            F.concat(F.upper(F.substring(spaced_field(n["field"]), 1, 1)), F.substring(spaced_field(n["field"]), 2, 1 << 30))
        )
        listed = F.filter(F.coalesce(c(f"{section}.notes"), F.array().cast("array<struct<field:string,value:string>>")), lambda n: F.length(n["value"]) > 0)
        return F.transform(
            listed,
            lambda n: F.struct(label(n).alias("label"), n["value"].alias("value"), F.lit("note").alias("kind"), F.lit(None).cast("string").alias("unit")),
        )

    above = lambda name: F.when(c(name) > 0, c(name))
    count = lambda label, name: made(label, above(name).cast("long"), "count")
    length = lambda label, section, name: measure(label, above(f"{section}.{name}"), c(f"{section}.distanceUnit"))
    rated = c("pointOfInterest.poiType").isin("Marina", "Anchorage", "Business", "BoatRamp")
    reviewed = rated & (c("reviewSummary.numberOfReviews") > 0)
    featured = rated & (F.length("featuredReview.text") > 0)
    shown = lambda condition, x: F.when(condition, x)
    return joined([
        ("review", "Reviews", [
            made("Average rating", shown(reviewed, c("reviewSummary.averageRating")), "rating"),
            made("Reviews", shown(reviewed, c("reviewSummary.numberOfReviews")), "count"),
        ]),
        ("featuredReview", "Featured review", [
            made("Title", shown(featured, c("featuredReview.title"))), made("Review", shown(featured, c("featuredReview.text")), "note"),
            made("Reviewed by", shown(featured, c("featuredReview.createdBy"))),
        ]),
        ("notes", "Notes", [notes("pointOfInterest")]),
        ("dockage", "Dockage", [
            flag("Docks", c("dockage.isFree")), count("Berths in total", "dockage.total"), count("Berths for visiting vessels", "dockage.transient"),
            length("Maximum LOA", "dockage", "loaMax"), length("Maximum beam", "dockage", "beamMax"), *offers("dockage"), notes("dockage"),
        ]),
        ("mooring", "Mooring", [
            flag("Moorings", c("mooring.isFree")), *offers("mooring"), count("Moorings in total", "mooring.total"),
            count("Transient moorings", "mooring.transient"), notes("mooring"),
        ]),
        ("contact", "Contact", [
            made("VHF", c("contact.vhfChannel")), made("Phone", safe_link(F.concat(F.lit("tel:"), F.nullif("contact.phone", F.lit("")))), "link"),
            made("After hours", c("contact.afterHourContact")),
            made("Email", safe_link(F.concat(F.lit("mailto:"), F.nullif("contact.email", F.lit("")))), "link"), made("Website", safe_link(c("contact.website")), "link"),
        ]),
        ("fuel", "Fuel", [*offers("fuel"), length("Fuel dock depth", "fuel", "depthFuel"), notes("fuel")]),
        ("amenities", "Amenities", [*offers("amenity"), notes("amenity")]),
        ("services", "Services", [*offers("services"), notes("services")]),
        ("retail", "Retail", [*offers("retail"), notes("retail")]),
        ("navigation", "Navigation", [
            made("Current", F.when(c("navigation.current") != "Unknown", c("navigation.current"))), *offers("navigation"),
            length("Bridge clearance", "navigation", "bridgeHeight"), length("Tidal range", "navigation", "tide"),
            length("Approach depth", "navigation", "depthApproach"), notes("navigation"),
        ]),
        ("business", "Business", [*offers("business"), notes("business")]),
    ])
