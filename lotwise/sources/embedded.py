"""Listing data inside scripts: an index of the wanted properties, made in one pass.

Scripts hold JSON or code that calls with JSON, so nothing is parsed as a whole. One scan notes where
each wanted property's value begins; a value is a string, a number, or an object, whose end is found
by its brackets, whatever it holds and however deep. Nested properties are looked up among the noted
ones that lie inside the object, so what a neighbouring listing says is never taken for this one's.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions import facts as X
from lotwise.functions.batches import slices
from lotwise.functions.text import unescape_string
from lotwise.sources.reading import Elements

# Property aliases of embedded listing data, and where a nested value stands.
EMBEDDED = {
    "year": ["vehicle_year", "vehicleYear", "model_year", "modelYear"],
    "make": ["vehicle_make_display_name", "vehicle_make", "vehicleMake", "make"],
    "model": ["vehicle_model_display_name", "vehicle_model", "vehicleModel", "model"],
    "trim": ["vehicle_trim_display_name", "vehicle_trim", "vehicleTrim", "trim"],
    "fuel": ["vehicle_fuel_type", "vehicle_fuel", "fuel_type", "fuelType", "fuel"],
    "gearbox": ["vehicle_transmission_type", "vehicle_transmission", "transmission_type", "transmissionType", "transmission"],
    "specifications": ["vehicle_specifications", "vehicleSpecifications", "specifications"],
    "power": ["horse_power", "horsepower", "power_hp", "powerHp"],
    "odometer": ["vehicle_odometer_data", "odometer_data", "odometerData"],
    "odometer_value": ["value", "amount"],
    "odometer_unit": ["unit", "units"],
    "condition": ["vehicle_condition", "condition"],
    "listing_condition": ["listing_condition", "listingCondition"],
}
TEXT_INSIDE = ["value", "name", "display_name", "displayName", "label"]
NUMBER_INSIDE = ["value", "amount", "number"]
QUOTES = re.compile(r"&quot;|&#34;|&#x22;|\\\"")

_WANTED = sorted({n.lower() for names in [*EMBEDDED.values(), TEXT_INSIDE, NUMBER_INSIDE] for n in names}, key=len, reverse=True)
_PROPERTY = re.compile(r"(?:^|(?<=[\[{,]))\s*([\"']?)(" + "|".join(_WANTED) + r")\1\s*:\s*", re.IGNORECASE)
_STRING = re.compile(r"\"((?:\\.|[^\"\\])*)\"|'((?:\\.|[^'\\])*)'", re.DOTALL)
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?")
_BRACKETS = re.compile(r"[{}]|\"(?:\\.|[^\"\\])*(?:\"|$)|'(?:\\.|[^'\\])*(?:'|$)", re.DOTALL)


class Properties:
    """Places of the wanted properties of one text, by lower-case name."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts: dict[str, list[int]] = {}
        self.ends: dict[int, int | None] = {}
        for found in _PROPERTY.finditer(text):
            self.starts.setdefault(found[2].lower(), []).append(found.end())

    def _inside(self, name: str, span: tuple[int, int]) -> Iterator[int]:
        places = self.starts.get(name.lower(), [])
        for k in range(bisect_left(places, span[0]), len(places)):
            if places[k] >= span[1]:
                return
            yield places[k]

    def _end(self, start: int) -> int | None:
        """Where the object that begins at ``start`` ends; each is measured once."""
        if start not in self.ends:
            depth, end = 0, None
            for found in _BRACKETS.finditer(self.text, start):
                if found[0] == "{":
                    depth += 1
                elif found[0] == "}":
                    depth -= 1
                    if depth == 0:
                        end = found.start()
                        break
            self.ends[start] = end
        return self.ends[start]

    def plain(self, name: str, span: tuple[int, int]) -> str | None:
        """First string or number that a property of this name has."""
        for start in self._inside(name, span):
            found = _STRING.match(self.text, start, span[1])
            if found:
                return found[1] if found[1] is not None else found[2]
            found = _NUMBER.match(self.text, start, span[1])
            if found:
                return found[0]
        return None

    def inner(self, name: str, span: tuple[int, int]) -> tuple[int, int] | None:
        """Span of the first whole object that a property of this name has."""
        for start in self._inside(name, span):
            if self.text.startswith("{", start):
                end = self._end(start)
                if end is not None and end <= span[1]:
                    return start + 1, end
        return None

    def find(self, names: Iterable[str], span: tuple[int, int] | None, inside: list[str]) -> str | None:
        """Value of the first name that has one, itself or inside its object under ``inside``."""
        if span is None:
            return None
        for name in names:
            value = self.plain(name, span)
            if value is None or value == "null":
                within = self.inner(name, span)
                value = None if within is None else self.find(inside, within, inside)
            if value is not None:
                return value
        return None


class _Scripts(Elements):
    """Texts of all script elements."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def enter(self, tag: str, attrs: dict[str, str]) -> object:
        return None

    def leave(self, frame: object) -> None:
        pass

    def handle_data(self, data: str) -> None:
        if self.tags["script"]:
            self.found.append(data)


_FIELDS = ["year", "make", "model", "trim", "fuel", "gearbox", "power", "odometer_value", "odometer_unit", "condition", "listing_condition"]


def embedded_values(html: str | None) -> dict[str, str | None]:
    """Raw values of one page's scripts, by field."""
    text = QUOTES.sub('"', "\n".join(_Scripts().read(html).found))
    found, whole = Properties(text), (0, len(text))

    def place(field: str) -> tuple[int, int] | None:
        return next((span for span in (found.inner(n, whole) for n in EMBEDDED[field]) if span is not None), None)

    parents = {"power": place("specifications"), "odometer_value": place("odometer"), "odometer_unit": place("odometer")}
    numbers = {"year", "power", "odometer_value"}
    return {f: found.find(EMBEDDED[f], parents.get(f, whole), NUMBER_INSIDE if f in numbers else TEXT_INSIDE) for f in _FIELDS}


def read_embedded(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per page: the raw values of its scripts; null where there are none."""
    source = pages.select(key, html)
    kind = source.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, 1)):
            rows = [embedded_values(text.as_py()) for text in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[f] for r in rows], pa.string()) for f in _FIELDS]], [key, *_FIELDS])

    return source.mapInArrow(read, f"`{key}` {kind}, " + ", ".join(f"{f} string" for f in _FIELDS))


def embedded_facts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Typed vehicle facts out of the scripts of pages (key, ``html``)."""
    read = read_embedded(pages, key)
    number = lambda c: F.col(c).try_cast("double")
    text = lambda c: unescape_string(F.col(c))
    named = X.split_model_display(text("model"), text("trim"))
    return read.select(
        key,
        X.structured_year(number("year")).alias("year"),
        X.structured_odometer(number("odometer_value"), text("odometer_unit")).alias("mileage"),
        X.clean_structured(text("make")).alias("make"),
        named["model"].alias("model"),
        named["variant"].alias("variant"),
        X.structured_fuel(text("fuel")).alias("fuel"),
        X.structured_gearbox(text("gearbox")).alias("gearbox"),
        X.structured_power(number("power")).alias("power_hp"),
        X.clean_structured(text("condition")).alias("condition"),
        X.clean_structured(text("listing_condition")).alias("listing_condition"),
    )
