"""The six tables: columns, declared lengths, defaults, keys and enums."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

NO_DEFAULT = object()
NOW = object()

# fixed values: the declaration order is the sort order
EVENT_TYPES = ["altitude_spike", "velocity_spike", "route_deviation", "ground_proximity"]
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]

# fixed values: positions of a state row in the landed snapshot
STATE_FIELDS = [
    ("icao24", "string"),
    ("callsign", "string"),
    ("origin_country", "string"),
    ("time_position", "bigint"),
    ("last_contact", "bigint"),
    ("longitude", "decimal(9,6)"),
    ("latitude", "decimal(9,6)"),
    ("baro_altitude", "decimal(8,2)"),
    ("on_ground", "boolean"),
    ("velocity", "decimal(7,2)"),
    ("true_track", "decimal(6,2)"),
    ("vertical_rate", "decimal(7,2)"),
    ("sensors", "array<int>"),
    ("geo_altitude", "decimal(8,2)"),
    ("squawk", "string"),
    ("spi", "boolean"),
    ("position_source", "int"),
]

# fixed values: seed rows of the two dimensions
SEED_AIRPORTS = [
    ("RKSI", "인천국제공항", "인천", "대한민국", "37.4602", "126.4407", "Asia/Seoul"),
    ("RKSS", "김포국제공항", "서울", "대한민국", "37.5583", "126.7906", "Asia/Seoul"),
    ("RKPC", "제주국제공항", "제주", "대한민국", "33.5113", "126.4930", "Asia/Seoul"),
    ("RKTN", "대구국제공항", "대구", "대한민국", "35.8964", "128.6589", "Asia/Seoul"),
    ("RJTT", "도쿄 하네다공항", "도쿄", "일본", "35.5494", "139.7798", "Asia/Tokyo"),
    ("ZBAA", "베이징 수도공항", "베이징", "중국", "40.0799", "116.6031", "Asia/Shanghai"),
]
SEED_AIRLINES = [
    ("KE", "대한항공", "대한민국"),
    ("OZ", "아시아나항공", "대한민국"),
    ("7C", "제주항공", "대한민국"),
    ("LJ", "진에어", "대한민국"),
    ("NH", "ANA", "일본"),
    ("CA", "중국국제항공", "중국"),
]


@dataclass(frozen=True)
class Col:
    name: str
    type: str
    length: int | None = None
    required: bool = False
    default: object = NO_DEFAULT


@dataclass(frozen=True)
class Table:
    name: str
    key: str
    columns: list[Col]
    # column -> (parent table, parent column)
    parents: dict[str, tuple[str, str]] = field(default_factory=dict)
    enums: dict[str, list[str]] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T._parse_datatype_string(", ".join(f"{c.name} {c.type}" for c in self.columns))


# fixed values: the declared columns, lengths, defaults, keys and enums of the six tables
AIRPORTS = Table(
    "airports",
    "airport_code",
    [
        Col("airport_code", "string", 4, True),
        Col("airport_name", "string", 100, True),
        Col("city", "string", 100),
        Col("country", "string", 100),
        Col("latitude", "decimal(9,6)", required=True),
        Col("longitude", "decimal(9,6)", required=True),
        Col("timezone", "string", 50, default="Asia/Seoul"),
    ],
)

AIRLINES = Table(
    "airlines",
    "carrier_code",
    [
        Col("carrier_code", "string", 3, True),
        Col("carrier_name", "string", 100, True),
        Col("country", "string", 100),
    ],
)

FLIGHTS = Table(
    "flights",
    "flight_id",
    [
        Col("flight_id", "bigint", required=True),
        Col("callsign", "string", 10),
        Col("icao24", "string", 10),
        Col("carrier_code", "string", 3),
        Col("origin_airport", "string", 4),
        Col("dest_airport", "string", 4),
        Col("scheduled_dep_time", "timestamp"),
        Col("scheduled_arr_time", "timestamp"),
        Col("actual_dep_time", "timestamp"),
        Col("actual_arr_time", "timestamp"),
        Col("dep_delay_min", "int", default=0),
        Col("arr_delay_min", "int", default=0),
        Col("distance_miles", "decimal(8,2)"),
        Col("flight_date", "date", required=True),
        Col("created_at", "timestamp", default=NOW),
    ],
    parents={
        "carrier_code": ("airlines", "carrier_code"),
        "origin_airport": ("airports", "airport_code"),
        "dest_airport": ("airports", "airport_code"),
    },
)

POSITIONS = Table(
    "flight_positions",
    "position_id",
    [
        Col("position_id", "bigint", required=True),
        Col("icao24", "string", 10, True),
        Col("callsign", "string", 10),
        Col("flight_id", "bigint"),
        Col("position_time", "timestamp", required=True),
        Col("latitude", "decimal(9,6)"),
        Col("longitude", "decimal(9,6)"),
        Col("baro_altitude", "decimal(8,2)"),
        Col("geo_altitude", "decimal(8,2)"),
        Col("velocity", "decimal(7,2)"),
        Col("true_track", "decimal(6,2)"),
        Col("vertical_rate", "decimal(7,2)"),
        Col("on_ground", "boolean", default=False),
        Col("squawk", "string", 4),
        Col("created_at", "timestamp", default=NOW),
    ],
    parents={"flight_id": ("flights", "flight_id")},
)

WEATHER = Table(
    "weather_observations",
    "obs_id",
    [
        Col("obs_id", "bigint", required=True),
        Col("airport_code", "string", 4),
        Col("observed_at", "timestamp", required=True),
        Col("wind_speed_knots", "decimal(5,1)"),
        Col("wind_direction_deg", "smallint"),
        Col("visibility_miles", "decimal(5,2)"),
        Col("ceiling_ft", "int"),
        Col("temperature_c", "decimal(5,1)"),
        Col("dewpoint_c", "decimal(5,1)"),
        Col("altimeter_inhg", "decimal(6,2)"),
        Col("precipitation_inch", "decimal(5,2)", default=0),
        Col("raw_metar", "string"),
        Col("created_at", "timestamp", default=NOW),
    ],
    parents={"airport_code": ("airports", "airport_code")},
)

ANOMALIES = Table(
    "anomaly_events",
    "event_id",
    [
        Col("event_id", "bigint", required=True),
        Col("icao24", "string", 10, True),
        Col("flight_id", "bigint"),
        Col("position_id", "bigint"),
        Col("detected_at", "timestamp", required=True, default=NOW),
        Col("event_type", "string", required=True),
        Col("severity", "string", required=True, default="LOW"),
        Col("latitude", "decimal(9,6)"),
        Col("longitude", "decimal(9,6)"),
        Col("altitude_m", "decimal(8,2)"),
        Col("velocity_ms", "decimal(7,2)"),
        Col("description", "string"),
        Col("llm_explanation", "string"),
        Col("response_procedure", "string"),
        Col("is_resolved", "boolean", default=False),
        Col("resolved_at", "timestamp"),
        Col("created_at", "timestamp", default=NOW),
    ],
    parents={
        "flight_id": ("flights", "flight_id"),
        "position_id": ("flight_positions", "position_id"),
    },
    enums={"event_type": EVENT_TYPES, "severity": SEVERITIES},
)

TABLES = {t.name: t for t in (AIRPORTS, AIRLINES, FLIGHTS, POSITIONS, WEATHER, ANOMALIES)}
