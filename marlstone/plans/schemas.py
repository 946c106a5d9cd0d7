"""Structured answers as schemas for ``from_json``; strict reading rejects other fields."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "search_plan": "queries array<string>, intent string, filters map<string,string>",
    "answer_check": "supported boolean, reason string, missing array<string>",
    "entity_extraction": "entities array<struct<name:string,type:string,evidence:string>>",
    "rdf_extract": "facts array<struct<subject:string,predicate:string,object:string,object_type:string,qualifiers:map<string,struct<value:string,value_type:string>>,evidence:string>>",
}


def parsed(text: Column | str, name: str) -> Column:
    """The answer as a struct; null where it is no JSON object."""
    return F.from_json(text, SCHEMAS[name], {"mode": "PERMISSIVE"})


def strict(text: str, name: str) -> dict:
    """One answer, with exactly the schema's fields at the top."""
    value = json.loads(text)
    wanted = {f.name for f in T._parse_datatype_string(SCHEMAS[name]).fields}
    if not isinstance(value, dict) or set(value) != wanted:
        raise ValueError(f"{name} must have the fields {', '.join(sorted(wanted))}")
    return value
