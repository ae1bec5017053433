"""Schemas of the input files, column name to type.

Fixed values: the column names are those of the files.
"""

from __future__ import annotations

INCUBATION = {
    "Date": "string",
    "Time": "string",
    "Time.Point": "string",
    "day": "double",
    "ElapsedDays": "double",
    "Bottle": "string",
    "Treatment": "string",
    "Depth": "string",
    "Rep": "string",
    "CO2.sys.ppm.p": "string",
    "CH4.sys.ppm.p": "string",
    "CO2.air.ppm": "double",
    "CH4.air.ppm": "double",
    "CO2.sys.ppm": "double",
    "CH4.sys.ppm": "double",
}
CARBON = {"Bottle": "string", "C.g": "double", "C.mol": "double"}
SENSOR = {"start_datetime": "string", "result_value": "string"}
STATION_LIST = {"StationID": "bigint", "Name": "string", "State": "string", "Region": "string"}
STATION_METADATA = {
    "id": "bigint",
    "name": "string",
    "lat": "double",
    "lon": "double",
    "State": "string",
    "Region": "string",
    "ObjName": "string",
}
SHORELINE = {"Region": "string", "Abb": "string", "Marsh shore (km)": "double"}
SERIES = {"t": "string", "v": "string", "f": "string"}
PAGE = {
    "station": "string",
    "chunk_begin": "string",
    "t": "timestamp_ntz",
    "v": "double",
    "f": "string",
}


def ddl(schema: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in schema.items())
