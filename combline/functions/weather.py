"""Words for weather measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weather codes that mean precipitation.
RAINY_CODES = [51, 53, 55, 56, 57, 61, 63, 65, 66, 67, 71, 73, 75, 77, 80, 81, 82, 85, 86, 95, 96, 99]
#: Weather codes in words.
CODES = {
    0: "Clear", 1: "Mainly clear", 2: "Partly cloudy", 3: "Overcast", 45: "Fog", 48: "Depositing rime fog", 51: "Light drizzle", 53: "Moderate drizzle", 55: "Dense drizzle",
    56: "Light freezing drizzle", 57: "Dense freezing drizzle", 61: "Slight rain", 63: "Moderate rain", 65: "Heavy rain", 66: "Light freezing rain", 67: "Heavy freezing rain",
    71: "Slight snow fall", 73: "Moderate snow fall", 75: "Heavy snow fall", 77: "Snow grains", 80: "Slight rain showers", 81: "Moderate rain showers", 82: "Violent rain showers",
    85: "Slight snow showers", 86: "Heavy snow showers", 95: "Thunderstorm", 96: "Thunderstorm with slight hail", 99: "Thunderstorm with heavy hail",
}
#: Upper limits and words.
TEMPERATURE = [(32, "Freezing"), (50, "Cool"), (70, "Mild"), (85, "Warm"), (None, "Hot")]
HUMIDITY = [(40, "dry"), (65, "moderately humid"), (None, "humid")]
CLOUD = [(20, "mostly clear"), (60, "partly cloudy"), (None, "mostly cloudy")]
DAYPART = [(12, "morning"), (17, "afternoon"), (None, "evening")]


def phrase(value: Column, table: list[tuple[float | None, str]]) -> Column:
    """The word of the first limit that value lies below; null for null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, word in table[:-1]:
        out = out.when(value < limit, word)
    return out.otherwise(table[-1][1])


def describe(hour: Column, temperature: Column, humidity: Column, cloud: Column, code: Column) -> Column:
    """The sentence for one observation; null if a measure is null."""
    named = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    condition = F.coalesce(F.element_at(named, code.cast("int")), F.concat(F.lit("weather code "), code.cast("string")))
    parts = [phrase(temperature, TEMPERATURE), F.lit(" and "), phrase(humidity, HUMIDITY), F.lit(" "), phrase(hour, DAYPART), F.lit(" with "), phrase(cloud, CLOUD), F.lit(" skies and "), condition, F.lit(" conditions.")]
    return F.concat(*parts)
