"""Classification and field normalisation of component records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geneweft.functions.values import is_filled, members_of, pick_present, present, variant_json, variant_text

# fixed values: synonyms of each promoted field, in order of preference
FIELD_KEYS = {
    "collection": ("collection", "type", "category", "class"),
    "name": ("name", "id", "identifier", "part_name", "device_name"),
    "organism": ("organism", "host", "chassis", "species"),
    "gate_type": ("gate_type", "gateType", "logic", "logic_type"),
    "gate_family": ("type", "family", "function"),
    "sensor_type": ("sensor_type", "sensorType", "input_type", "signal", "inducer"),
    "output_type": ("output_type", "outputType", "reporter", "protein", "fluorophore"),
    "description": ("description", "desc", "notes", "note"),
    "response": ("response_function", "responseFunction", "response", "transfer_function"),
    "toxicity": ("toxicity", "toxic", "tox"),
    "metabolic_burden": ("metabolic_burden", "metabolicBurden", "burden", "load", "metabolic_load"),
}
EQUATION_KEYS = ("equation", "model", "name", "type")
PARAMETER_KEYS = ("parameters", "params", "parameter", "coefficients")
WRAPPER_KEYS = ("ucf", "UCF", "data", "entries", "objects", "components")
# end of fixed values


def field(fields: Column, name: str) -> Column:
    """A promoted field by its synonyms, out of a map without empty values."""
    return pick_present(fields, *FIELD_KEYS[name])


def is_gate(collection: Column) -> Column:
    return F.lower(collection).contains("gate")


def is_output(collection: Column) -> Column:
    c = F.lower(collection)
    return c.contains("output") & c.contains("device")


def is_sensor(collection: Column) -> Column:
    c = F.lower(collection)
    return c.contains("sensor") | (c.contains("input") & ~c.contains("output"))


def component_role(collection: Column) -> Column:
    """gate, output, sensor or component, tested in that order."""
    return (
        F.when(is_gate(collection), F.lit("gate"))
        .when(is_output(collection), F.lit("output"))
        .when(is_sensor(collection), F.lit("sensor"))
        .otherwise(F.lit("component"))
    )


def response_function(value: Column) -> Column:
    """Struct of equation (text), parameters and raw (JSON) from a response given as a variant.

    An object yields its equation and parameters, or itself as raw when it has neither;
    anything else is kept as raw, a text with its quotes.
    """
    members = F.map_filter(members_of(value), lambda _, v: is_filled(v))
    equation = variant_text(pick_present(members, *EQUATION_KEYS))
    parameters = variant_json(pick_present(members, *PARAMETER_KEYS))
    parsed = equation.isNotNull() | parameters.isNotNull()
    return F.when(
        is_filled(value),
        F.struct(
            equation.alias("equation"),
            parameters.alias("parameters"),
            F.when(~parsed, variant_json(value)).alias("raw"),
        ),
    )


def toxicity_burden(fields: Column) -> Column:
    held = present(fields)
    return F.struct(
        field(held, "toxicity").alias("toxicity"),
        field(held, "metabolic_burden").alias("metabolic_burden"),
    )
